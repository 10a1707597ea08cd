"""A stored library: documents, chunks, vectors, tags and steps of every batch, committed together or not at all.

A batch writes each of its sinks to a folder of its own; one version file, committed last by a rename that fails if another
writer was faster, makes them all seen. The version names the batches that are in, so a batch that is repeated changes nothing,
and one that failed between two sinks leaves nothing that a reader sees. If another batch came first, the work is decided again on it.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking
from ..operators.versions import Versions
from . import ingest as job

SCHEMAS = {
    "documents": "path string, file_hash string, updated_at timestamp, version long, deleted boolean, n_chunks long",
    "chunks": f"path string, {chunking.CHUNK_SCHEMA}",
    "vectors": "path string, chunk_id string, key string, embedding array<float>",
    "tags": "path string, category_id string, confidence double, tagged_by string",
    "steps": "path string, step string, status string, details string, duration_ms long, created_at timestamp",
}
ATTEMPTS = 10
#: Batches that are read one by one; beyond, compact() first.
MANY = 200


class Library:
    def __init__(self, spark: SparkSession, path: str):
        """A library there is, or an empty one."""
        self.spark, self.path, self.versions = spark, path.rstrip("/"), Versions(spark, path)

    def read(self, sink: str, version: int | None = None) -> DataFrame:
        """The rows of a sink at a version, the latest by default, with the `batch` that wrote them.

        Of documents the last row of each path, deleted ones left out; of chunks, vectors and tags those of that row's batch;
        of steps all.
        """
        return self._live(sink, self.versions.read(version))

    def _all(self, sink: str, state: dict) -> DataFrame:
        folders = [f"{self.path}/{b['at']}/{sink}" for b in state.get("folders", [])]
        schema = f"{SCHEMAS[sink]}, batch string, place long"
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _live(self, sink: str, state: dict) -> DataFrame:
        return self._placed(sink, state).drop("place", "deleted")

    def _placed(self, sink: str, state: dict) -> DataFrame:
        rows = self._all(sink, state)
        if sink == "steps":
            return rows
        documents = self._all("documents", state)
        if sink == "documents":
            columns = [c for c in documents.columns if c not in ("path", "place")]
            last = documents.groupBy("path").agg(F.max_by(F.struct("place", *columns), "place").alias("d"))
            return last.select("path", *(f"d.{c}" for c in columns), "d.place").filter("not deleted")
        last = documents.groupBy("path").agg(F.max("place").alias("place"))
        return rows.join(last, ["path", "place"], "left_semi")

    def batches(self) -> list[str]:
        return self.versions.read().get("batches", [])

    def ingest(self, batch: str, files: DataFrame, at: Column, tagger: Callable[[DataFrame], DataFrame] | None = None, model=job.hashed_words, chunk_tokens: int = chunking.CHUNK_TOKENS, resolution: str = "auto") -> bool:
        """Take in files(path, text, file_hash, modified_at), paths distinct; False if the batch was taken in before.

        tagger(documents(path, text)) gives (path, category_id, confidence, tagged_by). If it raises, documents are kept without
        tags and their step `tagged` is failed. What becomes of a file is in its steps; duration_ms is the time that its batch
        took for the step. Every file counts whole; an empty batch is a batch.
        """
        return self._commit(batch, lambda state, at_folder, place: self._written(state, at_folder, place, batch, files, at, tagger, model, chunk_tokens, resolution))

    def delete(self, batch: str, paths: DataFrame, at: Column) -> bool:
        """Take out paths(path) with their chunks, vectors and tags; unknown paths change nothing. False if done before."""

        def write(state: dict, folder: str, place: int) -> None:
            gone = self._live("documents", state).join(paths.select("path").distinct(), "path", "left_semi")
            self._write(folder, "documents", gone.withColumn("deleted", F.lit(True)), batch, place)
            for sink in ("chunks", "vectors", "tags"):
                self._write(folder, sink, self.spark.createDataFrame([], SCHEMAS[sink]), batch, place)
            steps = gone.select("path", F.lit("deleted").alias("step"), F.lit("success").alias("status"), F.lit("{}").alias("details"), F.lit(0).alias("duration_ms"), at.alias("created_at"))
            self._write(folder, "steps", steps, batch, place)

        return self._commit(batch, write)

    def compact(self) -> None:
        """Write all live rows into one folder; earlier versions stay readable."""
        for _ in range(ATTEMPTS):
            now = self.versions.latest()
            state = self.versions.read(now)
            if len(state.get("folders", [])) < 2:
                return
            folder = f"data/{uuid.uuid4().hex}"
            for sink in SCHEMAS:
                rows = self._placed(sink, state)
                rows.select(*self._columns(sink), "batch", "place").write.parquet(f"{self.path}/{folder}/{sink}")
            if self.versions.commit(now + 1, state | {"folders": [{"at": folder}]}):
                return
        raise RuntimeError(f"{self.path}: other writers were faster {ATTEMPTS} times")

    def _commit(self, batch: str, write: Callable[[dict, str, int], None]) -> bool:
        for _ in range(ATTEMPTS):
            now = self.versions.latest()
            state = self.versions.read(now)
            if batch in state.get("batches", []):
                return False
            if len(state.get("folders", [])) >= MANY:
                self.compact()
                continue
            folder = f"data/{uuid.uuid4().hex}"
            write(state, folder, now + 1)
            if self.versions.commit(now + 1, {"batches": [*state.get("batches", []), batch], "folders": [*state.get("folders", []), {"at": folder}]}):
                return True
        raise RuntimeError(f"{self.path}: other writers were faster {ATTEMPTS} times")

    @staticmethod
    def _columns(sink: str) -> list[str]:
        return [c.split()[0] for c in SCHEMAS[sink].split(", ")]

    def _write(self, folder: str, sink: str, rows: DataFrame, batch: str, place: int) -> tuple[DataFrame, int]:
        """The rows as they are written, and the milliseconds it took."""
        began = time.monotonic()
        path = f"{self.path}/{folder}/{sink}"
        typed = rows.select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in SCHEMAS[sink].split(", ")), F.lit(batch).alias("batch"), F.lit(place).cast("long").alias("place"))
        typed.write.parquet(path)
        return self.spark.read.schema(typed.schema).parquet(path), round(1000 * (time.monotonic() - began))

    def _written(self, state, folder, place, batch, files, at, tagger, model, chunk_tokens, resolution) -> None:
        began = time.monotonic()
        known = self._live("documents", state)
        judged = job.judged(files, known.select("path", "file_hash", "updated_at"), resolution)
        aside = f"{self.path}/{folder}/judged"
        judged.write.parquet(aside)
        judged = self.spark.read.schema(judged.schema).parquet(aside)
        took = {"extracted": round(1000 * (time.monotonic() - began))}
        taken = judged.filter("status = 'success'")

        cut = chunking.recursive_chunks(taken.select(F.col("path").alias("document_id"), F.col("text").alias("content")), chunk_tokens)
        chunks, took["chunked"] = self._write(folder, "chunks", cut.withColumn("path", F.col("document_id")), batch, place)
        vectors = job.embedded(chunks.select("chunk_id", "content"), model=model).join(chunks.select("chunk_id", "path"), "chunk_id")
        _, took["embedded"] = self._write(folder, "vectors", vectors, batch, place)

        error = None
        none = self.spark.createDataFrame([], SCHEMAS["tags"])
        try:
            tags, took["tagged"] = self._write(folder, "tags", tagger(taken.select("path", "text")) if tagger else none, batch, place)
        except Exception as e:  # a model's failure costs the tags, not the documents
            error = f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"[:500]
            tags, took["tagged"] = none, 0
            none.withColumns({"batch": F.lit(batch), "place": F.lit(place).cast("long")}).write.mode("overwrite").parquet(f"{self.path}/{folder}/tags")

        counts = chunks.groupBy("path").agg(F.count("*").alias("n_chunks"))
        documents = taken.join(known.select("path", F.col("version").alias("_v")), "path", "left").join(counts, "path", "left")
        rows = documents.select("path", "file_hash", F.col("modified_at").alias("updated_at"), (F.coalesce("_v", F.lit(0)) + 1).alias("version"), F.lit(False).alias("deleted"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))
        self._write(folder, "documents", rows, batch, place)

        found = judged.select("path", "status", "decision").join(counts, "path", "left").join(tags.groupBy("path").agg(F.count("*").alias("n_tags")), "path", "left")
        self._write(folder, "steps", _steps(found, took, error if tagger else None, at), batch, place)


def _steps(found: DataFrame, took: dict[str, int], error: str | None, at: Column) -> DataFrame:
    """found(path, status, decision, n_chunks, n_tags) -> a row for each step that a file took."""
    ok = F.col("status") == "success"

    def step(name: str, status: str, when: Column, **details: Column) -> Column:
        row = F.struct(F.lit(name).alias("step"), F.lit(status).alias("status"), F.to_json(F.struct(*(v.alias(k) for k, v in details.items()))).alias("details"), F.lit(took.get(name, 0)).alias("duration_ms"))
        return F.when(when, row)

    steps = [
        step("discovered", "success", F.lit(True), decision=F.col("decision")),
        step("extracted", "success", F.col("status") != "failed", decision=F.col("decision")),
        step("chunked", "success", ok, n_chunks=F.coalesce("n_chunks", F.lit(0))),
        step("embedded", "success", ok, n_chunks=F.coalesce("n_chunks", F.lit(0))),
        step("tagged", "failed", ok, error=F.lit(error)) if error else step("tagged", "success", ok & (F.col("n_tags") > 0), n_tags=F.col("n_tags")),
        step("skipped", "skipped", F.col("status") == "skipped", decision=F.col("decision")),
        step("failed", "failed", F.col("status") == "failed", decision=F.col("decision")),
    ]
    return found.select("path", F.explode(F.array_compact(F.array(*steps))).alias("s"), at.alias("created_at")).select("path", "s.*", "created_at")
