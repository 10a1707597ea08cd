"""The ingest job: documents decided, cut, embedded and logged, as one plan for a whole batch of files."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import chunking, dedup

DIMENSION = 64
#: Words whose hashes a worker remembers at most.
REMEMBERED = 200_000
_word = re.compile(r"\w+")


class _Places(dict):
    """Where a word counts: its place, or the dimension more for a positive sign; begins anew when full."""

    def __init__(self, dimension: int):
        super().__init__()
        self.dimension = dimension

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = xxhash.xxh32_intdigest(word)
        self[word] = place = h % self.dimension + (self.dimension if h & 0x80000000 else 0)
        return place


_places: dict[int, _Places] = {}


def hashed_words(texts: pd.Series, dimension: int = DIMENSION) -> pd.Series:
    """Default embedder: signed hashed word counts of unit length; only a text without words is a zero vector."""
    out = np.zeros((len(texts), dimension), np.float32)
    places = _places.setdefault(dimension, _Places(dimension))
    for i, text in enumerate(texts):
        found = _word.findall((text or "").lower())
        counts = np.bincount(np.fromiter(map(places.__getitem__, found), np.int64, len(found)), minlength=2 * dimension)
        minus, plus = counts[:dimension], counts[dimension:]
        # words whose signs all cancel one another out count without signs
        out[i] = plus - minus if (plus != minus).any() else plus + minus
    norms = np.sqrt((out * out).sum(1, keepdims=True))
    return pd.Series(list(out / np.where(norms > 0, norms, 1)))


def embedded(chunks: DataFrame, known: DataFrame | None = None, model: Callable[[pd.Series], pd.Series] = hashed_words, name: str = "hashed") -> DataFrame:
    """chunks(chunk_id, content) -> (chunk_id, key, embedding). Each distinct text is embedded once, and none that
    known(key, embedding) has; a model is a batch function, loaded once for each task."""

    @F.pandas_udf("array<float>")
    def vector(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield model(batch)

    keyed = chunks.select("chunk_id", "content", F.sha2(F.concat_ws(":", F.lit(name), "content"), 256).alias("key"))
    fresh = keyed.groupBy("key").agg(F.first("content").alias("content"))
    if known is not None:
        fresh = fresh.join(known.select("key"), "key", "left_anti")
    vectors = fresh.select("key", vector("content").alias("embedding"))
    if known is not None:
        vectors = vectors.unionByName(known.select("key", "embedding"))
    return keyed.select("chunk_id", "key").join(vectors, "key")


def step_log(results: DataFrame, at: Column) -> DataFrame:
    """results(path, status, decision, n_chunks) -> (document, step, status, details, created_at): a row for each step that a document took."""
    step = lambda name, status, when=None: F.when(F.lit(True) if when is None else when, F.struct(F.lit(name).alias("step"), F.lit(status).alias("status")))
    took = F.col("status")
    steps = F.array_compact(F.array(step("discovered", "success"), step("extracted", "success", took != "failed"), step("chunked", "success", took == "success"), step("skipped", "skipped", took == "skipped"), step("failed", "failed", took == "failed")))
    rows = results.select(F.col("path").alias("document"), F.explode(steps).alias("s"), F.to_json(F.struct("decision", "n_chunks")).alias("details"))
    return rows.select("document", "s.*", "details", at.alias("created_at"))


def wiki_pending(results: DataFrame, jobs: DataFrame) -> DataFrame:
    """A pending compile job for each ingested document that has none yet."""
    from ..operators.curation import compile_jobs

    return compile_jobs(results.filter("status = 'success'").select(F.col("path").alias("document_id")), jobs)


def judged(files: DataFrame, stored: DataFrame, resolution: str = "auto") -> DataFrame:
    """files with `decision` and `status`: empty texts and conflicts fail, contents seen earlier in the batch or stored unchanged
    are skipped, the rest succeeds."""
    blank = F.btrim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")) == ""
    decided = dedup.decide(dedup.first_of_hash(files), stored, resolution)
    return decided.withColumn("status", F.when(blank, "failed").when(F.col("seen_before") | (F.col("decision") == "skip"), "skipped").when(F.col("decision") == "conflict", "failed").otherwise("success"))


def ingest(files: DataFrame, stored: DataFrame, at: Column, chunk_tokens: int = chunking.CHUNK_TOKENS, resolution: str = "auto") -> tuple[DataFrame, DataFrame, DataFrame]:
    """files(path, text, file_hash, modified_at), stored(path, file_hash, updated_at) -> (results, chunks, log).

    Empty texts fail, contents seen earlier in the batch or stored unchanged are skipped, the rest is new or
    an update and is cut. Failures are rows, not errors.
    """
    results = judged(files, stored, resolution)
    taken = results.filter("status = 'success'").select(F.col("path").alias("document_id"), F.col("text").alias("content"))
    chunks = chunking.recursive_chunks(taken, chunk_tokens)
    counts = chunks.groupBy("document_id").agg(F.count("*").alias("n_chunks"))
    results = results.join(counts, F.col("path") == F.col("document_id"), "left").select("path", "file_hash", "decision", "status", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))
    return results, chunks, step_log(results, at)
