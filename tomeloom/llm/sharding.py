"""Sharding by size-tiered compaction (operator 6). DataFrame functions and Spark's writers only.

A store is a folder:
  data/<commit>/part-*.parquet   immutable shards
  manifests/v<version>/          one row for each shard of that version: path, n_rows, n_bytes
  schema/                        the columns, for a store without rows

Arrivals are appended as the small files that their tasks write: the shards of a commit are a run, and a
version is a set of whole runs. Compaction takes each tier, the runs whose mean shard sizes lie within a
factor of TIER_BASE, that has FANOUT shards or more, and merges them into one run of files of the target size
without a shuffle: neighbouring file splits are read by one task that writes one file. A version becomes
visible by one rename of its manifest, which fails if another writer was first. The driver sees the names of
runs, one for each commit that is not yet merged, never those of shards.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, work_dir

TARGET_BYTES = 128 << 20
#: Sizes within this factor are alike.
TIER_BASE = 4.0
#: Shards that a tier must have to be merged.
FANOUT = 4
#: Manifest rows that are broadcast at most; beyond it the join shuffles.
BROADCAST_SHARDS = 500_000


class Conflict(RuntimeError):
    """Another writer has committed the version."""


def _rename(spark: SparkSession, old: str, new: str) -> None:
    """Move a folder in one step; an existing target is an error."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(old).toUri(), spark._jsc.hadoopConfiguration()) if "://" in old else jvm.org.apache.hadoop.fs.FileContext.getFileContext(spark._jsc.hadoopConfiguration())
    files.mkdir(path(new).getParent(), None, True)
    if files.util().exists(path(new)):
        raise Conflict(new)
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        files.rename(path(old), path(new), options)
    except Exception as error:
        if files.util().exists(path(new)):
            raise Conflict(new) from error
        raise


class Store:
    """A versioned store of shards at root. Each method is a few Spark jobs; nothing of the data passes the driver."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT):
        self.spark, self.root, self.target_bytes, self.fanout = spark, root.rstrip("/"), target_bytes, fanout

    def version(self) -> int:
        """The latest committed version; 0 if there is none."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifests")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return 0
        return max((int(s.getPath().getName()[1:]) for s in files.listStatus(path)), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        """path, n_rows, n_bytes of each shard of a version, the latest by default."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], "path string, n_rows long, n_bytes long")
        return self.spark.read.parquet(f"{self.root}/manifests/v{version:08d}")

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        return self._of_runs([r.run for r in self._runs(version).select("run").orderBy("run").collect()])

    def _of_runs(self, runs: list[str]) -> DataFrame:
        schema = self.spark.read.parquet(f"{self.root}/schema").schema
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{r}" for r in runs or ["schema"]))

    def _runs(self, version: int | None = None) -> DataFrame:
        """run, shards, n_bytes of each run of a version that has rows."""
        named = self.manifest(version).filter("n_rows > 0")
        return named.groupBy(F.substring_index("path", "/", 2).alias("run")).agg(F.count("*").alias("shards"), F.sum("n_bytes").alias("n_bytes"))

    def _written(self, df: DataFrame, commit: str) -> DataFrame:
        """Write df as shards of a commit; their manifest rows."""
        df.write.parquet(f"{self.root}/data/{commit}")
        rows = self.spark.read.schema(df.schema).parquet(f"{self.root}/data/{commit}")
        about = rows.metadataColumn("_metadata")
        shards = rows.groupBy(F.concat(F.lit(f"data/{commit}/"), about["file_name"]).alias("path"), about["file_size"].alias("n_bytes")).agg(F.count("*").alias("n_rows"))
        return shards.select("path", "n_rows", "n_bytes")

    def _commit(self, shards: DataFrame, version: int) -> int:
        staged = f"{self.root}/_staged/{uuid.uuid4().hex}"
        shards.write.parquet(staged)
        _rename(self.spark, staged, f"{self.root}/manifests/v{version:08d}")
        return version

    def append(self, df: DataFrame) -> int:
        """Add the rows of df as small shards; the new version. An empty df makes a version without new shards."""
        version = self.version() + 1
        if version == 1:
            df.limit(0).write.mode("ignore").parquet(f"{self.root}/schema")
        new = self._written(df, f"v{version:08d}-append-{uuid.uuid4().hex[:8]}")
        return self._commit(self.manifest(version - 1).unionByName(new), version)

    def tiers(self, version: int | None = None) -> DataFrame:
        """run, shards, n_bytes, tier of the runs whose shards are below half the target size on average."""
        mean = F.col("n_bytes") / F.col("shards")
        return self._runs(version).filter(mean < self.target_bytes / 2).withColumn("tier", F.floor(F.log(F.greatest(mean, F.lit(1.0))) / math.log(TIER_BASE)).cast("int"))

    def compact(self) -> int:
        """Merge every tier that has enough shards; the new version, or the latest if there was nothing to merge.

        One pass brings a tier's shards to the target size at once, so a row is rewritten once for
        each time that its run is alike to enough others, not at every size on the way.
        """
        version = self.version()
        tiers = self.tiers(version).groupBy("tier").agg(F.sum("shards").alias("shards"), F.sum("n_bytes").alias("n_bytes"), F.sort_array(F.collect_list("run")).alias("runs"))
        # merging one file into one file changes nothing
        tiers = [t for t in tiers.filter(F.col("shards") >= self.fanout).orderBy("tier").collect() if t.shards > self._files(t.n_bytes)]
        if not tiers:
            return version
        kept = self.manifest(version).filter(~F.substring_index("path", "/", 2).isin([r for t in tiers for r in t.runs]))
        for t in tiers:
            merged = self._written(self._of_runs(t.runs).coalesce(self._files(t.n_bytes)), f"v{version + 1:08d}-tier{t.tier}-{uuid.uuid4().hex[:8]}")
            kept = kept.unionByName(merged)
        return self._commit(kept, version + 1)

    def _files(self, n_bytes: int) -> int:
        return max(1, math.ceil(n_bytes / self.target_bytes))

    def vacuum(self) -> int:
        """Delete shards that the latest version doesn't name, and older manifests; the number of folders left out of it.

        Readers of older versions fail from then on. Folders are the unit: one goes when none of its shards is named.
        """
        latest = self.version()
        named = {r.folder for r in self.manifest(latest).select(F.substring_index("path", "/", 2).alias("folder")).distinct().collect()}
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        files = path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())
        gone = 0
        for s in files.listStatus(path(f"{self.root}/data")):
            if f"data/{s.getPath().getName()}" not in named:
                gone += bool(files.delete(s.getPath(), True))
        for s in files.listStatus(path(f"{self.root}/manifests")):
            if int(s.getPath().getName()[1:]) < latest:
                files.delete(s.getPath(), True)
        return gone


def shard_name(rows: DataFrame):
    """Version, kind and number of the file that a row of read() is in, without the random part of its name."""
    path = rows.metadataColumn("_metadata")["file_path"]
    return F.concat(F.regexp_extract(path, r"/data/(v\d+-[a-z0-9]+)-[0-9a-f]+/", 1), F.lit("/"), F.regexp_extract(path, r"/part-(\d+)", 1))


#: Shares of the rows that arrive together: an older bulk and ever smaller arrivals, by the hash of the id.
ARRIVALS = ((0, 1, 2, 3), (4, 5), (6,), (7,))


def shard(documents: DataFrame, id_col: str = "doc_id", root: str | None = None, target_bytes: int = TARGET_BYTES) -> tuple[Store, DataFrame]:
    """Store documents as arrivals, each a version of its own, compact them, and read the last version back.

    All columns are kept as they are, whatever their names. Null ids arrive like others; repeated rows stay
    repeated; texts of any length are one row of one shard; an empty table gives an empty store of the same columns.
    """
    spark = documents.sparkSession
    store = Store(spark, root or work_dir(spark), target_bytes)
    arrival = F.pmod(F.xxhash64(F.col(id_col)), F.lit(8))
    for part in ARRIVALS:
        store.append(documents.filter(arrival.isin(list(part))))
    store.compact()
    return store, store.read()


def op6_shard(spark, sf_dir):
    """doc_id, shard, shard_rows, shard_bytes, version of every document. No document is left out: null ids, empty
    texts and repeated rows included; of an empty table nothing comes back."""
    store, rows = shard(table(spark, sf_dir, "documents"))
    named = rows.select("doc_id", shard_name(rows).alias("shard"), rows.metadataColumn("_metadata")["file_name"].alias("file"))
    sizes = store.manifest().select(F.substring_index("path", "/", -1).alias("file"), F.col("n_rows").alias("shard_rows"), F.col("n_bytes").alias("shard_bytes"))
    # a row for each shard: the store holds at most its bytes over the target, and fewer than FANOUT in each tier
    sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_SHARDS else sizes
    return named.join(sizes, "file", "left").select("doc_id", "shard", "shard_rows", "shard_bytes", F.lit(store.version()).alias("version"))
