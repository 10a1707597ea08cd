"""A durable table of keyed rows: upserts and deletes rewrite only the buckets of the keys that they touch.

A version names a folder for each bucket. New folders are written first and the version is committed last, by a rename that
fails if another writer was faster; then the work is taken up again on that writer's version, or, if it touched other
buckets only, committed on top of it as it is. Readers see one whole version. Nothing is changed in place.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..work import names, stored
from .versions import Versions

BUCKETS = 16
ATTEMPTS = 10


class Conflict(Exception):
    """Other writers were faster as often as an operation may be tried."""


class Table:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.versions = spark, path.rstrip("/"), Versions(spark, path)
        first = self.versions.read(1)
        if not first:
            raise ValueError(f"there is no table at {path}")
        self.key, self.buckets, self.schema = first["key"], first["buckets"], StructType.fromJson(first["schema"])

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: StructType, key: str, buckets: int = BUCKETS) -> Table:
        """An empty table, version 1. `version` is added to the columns: 1 for a new key, one more with each upsert."""
        schema = StructType([f for f in schema.fields if f.name != "version"]).add("version", "long")
        if not Versions(spark, path).commit(1, {"key": key, "buckets": buckets, "schema": json.loads(schema.json()), "folders": {}, "did": "create"}):
            raise ValueError(f"there is a table at {path}")
        return cls(spark, path)

    def _bucket(self):
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def _of(self, state: dict, only: set[str] | None = None) -> DataFrame:
        folders = [f"{self.path}/{folder}" for b, folder in sorted(state["folders"].items()) if only is None or b in only]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, the latest by default."""
        return self._of(self.versions.read(version))

    def by_keys(self, keys: DataFrame, version: int | None = None) -> DataFrame:
        """The rows of keys(key): only their buckets are read."""
        keys = keys.select(self.key).distinct()
        return self._of(self.versions.read(version), self._touched(keys)).join(keys, self.key, "left_semi")

    def _touched(self, rows: DataFrame) -> set[str]:
        return {str(r.b) for r in rows.select(self._bucket().alias("b")).distinct().collect()}  # at most `buckets` numbers

    def _change(self, did: str, plan: Callable[[DataFrame], tuple[set[str], Callable[[DataFrame], DataFrame]]]) -> int:
        """Replace the rows of some buckets: plan(all rows) names them and says what becomes of their rows. The new version; a plan
        that names none makes no version. It is made anew if another writer has changed one of the buckets meanwhile."""
        for _ in range(ATTEMPTS):
            base = self.versions.latest()
            before = self.versions.read(base)
            touched, rows_of = plan(self._of(before))
            if not touched:
                return base
            at = f"data/{uuid.uuid4().hex}"
            rows = rows_of(self._of(before, touched)).select(*self.schema.names).withColumn("_bucket", self._bucket())
            rows.repartition(self.buckets, "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{at}")
            there = {n.split("=")[1] for n in names(self.spark, f"{self.path}/{at}") if n.startswith("_bucket=")}
            new = {b: f"{at}/_bucket={b}" for b in touched & there}
            while True:
                now = self.versions.latest()
                state = self.versions.read(now)
                if any(state["folders"].get(b) != before["folders"].get(b) for b in touched):
                    break
                folders = {b: f for b, f in state["folders"].items() if b not in touched} | new
                if self.versions.commit(now + 1, state | {"folders": folders, "did": did}):
                    return now + 1
        raise Conflict(f"{self.path}: {ATTEMPTS} attempts to {did}")

    def upsert(self, rows: DataFrame, order: str | None = None) -> int:
        """Insert rows, or replace those of the same key; the new version of the table.

        Of several rows of a key the greatest by `order` counts; without it, or where it ties, repeated keys are an error.
        """
        rows = rows.select(*(c for c in self.schema.names if c != "version"))
        place = W.partitionBy(self.key).orderBy(F.desc(order) if order else F.lit(1))
        ranked = rows.withColumn("_r", F.rank().over(place)).filter("_r = 1").drop("_r")
        if not ranked.groupBy(self.key).count().filter("count > 1").isEmpty():
            raise ValueError("repeated keys without an order")

        touched = self._touched(ranked)
        return self._change("upsert", lambda _: (touched, self._merged(ranked)))

    def _merged(self, new: DataFrame) -> Callable[[DataFrame], DataFrame]:
        """How old rows become old and new ones, of which the new have the next version of their key."""

        def merged(old: DataFrame) -> DataFrame:
            known = old.select(F.col(self.key).alias("_k"), F.col("version").alias("_v"))
            rows = new.join(known, F.col(self.key).eqNullSafe(F.col("_k")), "left").withColumn("version", F.coalesce("_v", F.lit(0)) + 1).drop("_k", "_v")
            keys = new.select(F.col(self.key).alias("_k"))
            return old.join(keys, F.col(self.key).eqNullSafe(F.col("_k")), "left_anti").unionByName(rows)

        return merged

    def update(self, did: str, choose: Callable[[DataFrame], DataFrame]) -> int:
        """Upsert choose(all rows), keys distinct, chosen again on the newest rows whenever another writer touched the same
        buckets: compare and set."""

        def plan(rows: DataFrame):
            chosen = stored(choose(rows).select(*(c for c in self.schema.names if c != "version")))
            return self._touched(chosen), self._merged(chosen)

        return self._change(did, plan)

    def delete(self, keys: DataFrame) -> int:
        """Remove the rows of keys(key); unknown keys change nothing."""
        keys = keys.select(F.col(self.key).alias("_k")).distinct()
        touched = self._touched(keys.withColumnRenamed("_k", self.key))
        return self._change("delete", lambda _: (touched, lambda old: old.join(keys, F.col(self.key).eqNullSafe(F.col("_k")), "left_anti")))

    def history(self) -> list[tuple[int, str]]:
        return [(v, self.versions.read(v)["did"]) for v in range(1, self.versions.latest() + 1)]

