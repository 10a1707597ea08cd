"""What to do with incoming documents that may be stored already."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def decide(incoming: DataFrame, stored: DataFrame, resolution: str = "auto") -> DataFrame:
    """incoming(path, file_hash, modified_at) and stored(path, file_hash, updated_at) -> incoming with `decision`.

    No stored row: new. Same hash: skip. A stored row newer than the file is a conflict: auto and skip
    leave it, duplicate updates, manual keeps the conflict. Else update.
    """
    old = stored.select(F.col("path").alias("_path"), F.col("file_hash").alias("_hash"), F.col("updated_at").alias("_updated"))
    conflict = {"auto": "skip", "skip": "skip", "duplicate": "update", "manual": "conflict"}[resolution]
    rows = incoming.join(old, F.col("path") == F.col("_path"), "left")
    decision = F.when(F.col("_path").isNull(), "new").when(F.col("_hash") == F.col("file_hash"), "skip").when(F.col("_updated") > F.col("modified_at"), conflict).otherwise("update")
    return rows.withColumn("decision", decision).drop("_path", "_hash", "_updated")


def first_of_hash(files: DataFrame) -> DataFrame:
    """files(path, file_hash) with `seen_before`: an earlier path of the batch has the same content."""
    least = files.groupBy("file_hash").agg(F.min("path").alias("_first"))
    rows = files.join(least, files["file_hash"].eqNullSafe(least["file_hash"])).drop(least["file_hash"])
    return rows.withColumn("seen_before", F.coalesce(F.col("path") > F.col("_first"), F.lit(False))).drop("_first")


def log_rows(decided: DataFrame, at: Column) -> DataFrame:
    """Audit rows of decisions: conflict is failed, skip partial, else success."""
    status = F.when(F.col("decision") == "conflict", "failed").when(F.col("decision") == "skip", "partial").otherwise("success")
    return decided.select(F.col("path").alias("document"), F.lit("dedup").alias("action"), status.alias("status"), F.to_json(F.struct("decision", "file_hash")).alias("details"), at.alias("created_at"))


def replace_chunks(chunks: DataFrame, updated: DataFrame, fresh: DataFrame) -> DataFrame:
    """Chunks with all of the updated documents' old ones replaced by fresh ones."""
    return chunks.join(updated.select("document_id").distinct(), "document_id", "left_anti").unionByName(fresh)


def bump(documents: DataFrame, updated: DataFrame, at: Column) -> DataFrame:
    """Stored rows with the version, hash and time of those in updated(document_id, file_hash) moved on."""
    new = updated.select(F.col("document_id").alias("_id"), F.col("file_hash").alias("_hash"))
    rows = documents.join(new, F.col("document_id") == F.col("_id"), "left")
    hit = F.col("_id").isNotNull()
    return rows.withColumns({"version": F.when(hit, F.col("version") + 1).otherwise(F.col("version")), "file_hash": F.coalesce("_hash", "file_hash"), "updated_at": F.when(hit, at).otherwise(F.col("updated_at"))}).drop("_id", "_hash")


def latest(rows: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """The newest row of each key, ties by the greatest `tie`."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(at), F.desc(tie)))
    return rows.withColumn("_r", rank).filter("_r = 1").drop("_r")
