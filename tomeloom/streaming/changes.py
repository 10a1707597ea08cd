"""File changes as a stream: filtered, routed to watches, collapsed, and handed on to ingest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import READABLE, suffix

CHANGES = "change_type string, path string, previous_path string, ts timestamp, size_bytes long, mime_type string"
#: Poll intervals in seconds by kind of storage.
INTERVALS = {"local": 0, "gdrive": 300, "onedrive": 300}
MAX_LOCAL_WATCHES = 100


def read_changes(spark: SparkSession, folder: str, schema: str = CHANGES) -> DataFrame:
    """Change events that land as JSON lines in a folder; the checkpoint of the query keeps its place."""
    return spark.readStream.schema(schema).json(folder)


def ingestable(change_type: Column, path: Column) -> Column:
    """Created or modified, of a readable suffix, in no hidden folder."""
    hidden = F.exists(F.split(path, "/"), lambda p: F.startswith(p, F.lit(".")))
    return change_type.isin("created", "modified") & suffix(path).isin(*READABLE) & ~hidden


def routed(changes: DataFrame, watches: DataFrame) -> DataFrame:
    """Changes with the watch(watch_id, prefix) whose folder holds their path.

    Joined by the folders that hold a path, so the registry may be of any size.
    """
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    held = changes.withColumn("_folder", F.explode(folders))
    return held.join(watches.withColumn("_prefix", F.rtrim("prefix", F.lit("/"))), F.col("_folder") == F.col("_prefix")).drop("_folder", "_prefix")


def without_storms(changes: DataFrame, late: str = "10 minutes") -> DataFrame:
    """One event of a path and kind within the watermark: one save often raises several."""
    return changes.withWatermark("ts", late).dropDuplicatesWithinWatermark(["path", "change_type"])


def newest(changes: DataFrame) -> DataFrame:
    """The last change of each path of a batch."""
    return changes.groupBy("path").agg(F.max_by(F.struct("change_type", "previous_path", "ts"), F.struct("ts", "change_type")).alias("c")).select("path", "c.*")


def watch_totals(events: DataFrame) -> DataFrame:
    """(watch_id, processed, failed, last_event), of a batch or running over a stream."""
    return events.groupBy("watch_id").agg(F.count_if(~F.col("failed")).alias("processed"), F.count_if(F.col("failed")).alias("failed"), F.max("ts").alias("last_event"))


def registry(watches: DataFrame) -> DataFrame:
    """watches(backend, path) once each, with their poll interval; too many local ones are an error."""
    rows = watches.dropDuplicates(["backend", "path"])
    if rows.filter("backend = 'local'").count() > MAX_LOCAL_WATCHES:
        raise ValueError(f"more than {MAX_LOCAL_WATCHES} local watches")
    seconds = F.create_map(*[F.lit(x) for pair in INTERVALS.items() for x in pair])
    return rows.withColumn("interval_seconds", F.try_element_at(seconds, F.col("backend")))


def run(changes: DataFrame, checkpoint: str, ingest: Callable[[DataFrame, int], None], delete: Callable[[DataFrame, int], None] | None = None):
    """Hand each batch's newest ingestable changes to ingest(df, batch_id) and, if wanted, deletions to delete; everything
    there is, then stop. A batch that is repeated after a failure has the same id."""

    def each(batch: DataFrame, batch_id: int) -> None:
        last = newest(batch)
        ingest(last.filter(ingestable(F.col("change_type"), F.col("path"))), batch_id)
        if delete:
            delete(last.filter("change_type = 'deleted'"), batch_id)

    return changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def cloud_changes(pages: DataFrame) -> DataFrame:
    """pages(text): landed JSON of a cloud drive's change pages -> change rows; items removed, trashed or without a file
    are deleted, others modified; roots are left out."""
    item = "struct<fileId:string,removed:boolean,time:string,file:struct<name:string,trashed:boolean,size:string,mimeType:string>,id:string,name:string,root:struct<x:string>,deleted:struct<state:string>,size:long,lastModifiedDateTime:string>"
    page = F.from_json("text", f"struct<changes:array<{item}>,value:array<{item}>>")
    rows = pages.select(F.explode(F.concat(F.coalesce(page["changes"], F.array().cast(f"array<{item}>")), F.coalesce(page["value"], F.array().cast(f"array<{item}>")))).alias("c")).filter("c.root is null")
    drive = F.col("c.fileId").isNotNull()
    gone = F.when(drive, F.coalesce("c.removed", F.lit(False)) | F.col("c.file").isNull() | F.coalesce("c.file.trashed", F.lit(False))).otherwise(F.col("c.deleted").isNotNull())
    return rows.select(F.when(gone, "deleted").otherwise("modified").alias("change_type"), F.coalesce("c.file.name", "c.name", "c.fileId", "c.id").alias("path"), F.try_to_timestamp(F.coalesce("c.time", "c.lastModifiedDateTime")).alias("ts"), F.coalesce(F.col("c.file.size").cast("long"), "c.size").alias("size_bytes"))
