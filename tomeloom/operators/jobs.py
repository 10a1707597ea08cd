"""A queue of compile jobs on a durable table: workers claim disjoint jobs under leases that run out."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType, TimestampType

from .tables import BUCKETS, Table

JOB = StructType().add("document_id", LongType()).add("status", StringType()).add("worker", StringType()).add("lease_until", TimestampType()).add("error", StringType()).add("compiled_at", TimestampType())
LEASE = dt.timedelta(minutes=30)
BATCH = 20


def create(spark: SparkSession, path: str, buckets: int = BUCKETS) -> Table:
    return Table.create(spark, path, JOB, "document_id", buckets)


def _pending(documents: DataFrame) -> DataFrame:
    empty = {f.name: F.lit(None).cast(f.dataType) for f in JOB.fields[2:]}
    return documents.select("document_id", F.lit("pending").alias("status"), *(v.alias(k) for k, v in empty.items())).distinct()


def enqueue(jobs: Table, documents: DataFrame, again: bool = False) -> int:
    """A pending job for each of documents(document_id): all of them, those of a category or one, as the caller selects. Jobs that there
    are stay as they are; with again, all but those under a lease become pending."""

    def choose(rows: DataFrame) -> DataFrame:
        known = rows.filter("status = 'compiling'") if again else rows
        return _pending(documents).join(known.select("document_id"), "document_id", "left_anti")

    return jobs.update("enqueue", choose)


def claim(jobs: Table, worker: str, now: dt.datetime, n: int = BATCH, lease: dt.timedelta = LEASE, only: DataFrame | None = None) -> DataFrame:
    """Take the first n jobs by id that are pending or whose lease has run out; the jobs that the worker holds now.

    Two workers never hold one job: what is chosen is committed on the rows that it was chosen from. only(document_id) restricts
    the choice.
    """
    at = F.lit(now)

    def choose(rows: DataFrame) -> DataFrame:
        free = rows.filter((F.col("status") == "pending") | ((F.col("status") == "compiling") & (F.col("lease_until") < at)))
        if only is not None:
            free = free.join(only.select("document_id").distinct(), "document_id", "left_semi")
        return free.orderBy("document_id").limit(n).withColumns({"status": F.lit("compiling"), "worker": F.lit(worker), "lease_until": F.lit(now + lease)})

    return held(jobs, worker, now, jobs.update("claim", choose))


def held(jobs: Table, worker: str, now: dt.datetime, version: int | None = None) -> DataFrame:
    """The jobs of a worker whose lease runs."""
    return jobs.read(version).filter((F.col("status") == "compiling") & (F.col("worker") == worker) & (F.col("lease_until") >= F.lit(now)))


def finish(jobs: Table, worker: str, outcomes: DataFrame, now: dt.datetime) -> int:
    """outcomes(document_id, error) of a worker: completed, or failed where there is an error. Jobs whose lease it has lost stay."""

    def choose(rows: DataFrame) -> DataFrame:
        mine = rows.filter((F.col("status") == "compiling") & (F.col("worker") == worker) & (F.col("lease_until") >= F.lit(now))).drop("error")
        done = mine.join(outcomes.select("document_id", "error"), "document_id")
        return done.withColumns({"status": F.when(F.col("error").isNull(), "completed").otherwise("failed"), "compiled_at": F.when(F.col("error").isNull(), F.lit(now)), "lease_until": F.lit(None).cast("timestamp")})

    return jobs.update("finish", choose)
