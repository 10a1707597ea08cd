"""A table of vectors: distances, upsert, and top-k for a table of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Queries that are broadcast at once (64 floats each: 25 MB). More are dealt out in blocks of this size.
QUERY_BLOCK = 50_000
#: Queries and vectors that a task compares at once: 512 x 1,024 doubles are 4 MB, and several such arrays are held.
QUERIES_AT_ONCE, VECTORS_AT_ONCE = 512, 1_024


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine likeness; 0 for a zero vector, an error for different lengths, null for null."""
    lengths = F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of different lengths")).cast("double"))
    norms = norm(a) * norm(b)
    return F.when(a.isNull() | b.isNull(), F.lit(None)).otherwise(F.coalesce(lengths, F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)))


def distance(a: Column, b: Column, metric: str = "cosine") -> Column:
    if metric == "cosine":
        return 1 - cosine(a, b)
    if metric == "l2":
        return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))
    if metric == "ip":
        return 1 - dot(a, b)
    raise ValueError(f"unknown metric {metric}")


def similarity(d: Column) -> Column:
    """Score of a distance: never below 0."""
    return F.greatest(F.lit(0.0), 1 - d)


def upsert(old: DataFrame, new: DataFrame, dimension: int, key: str = "id") -> DataFrame:
    """The newest row of each id; a new vector of another length is an error."""
    checked = new.withColumn("embedding", F.when(F.size("embedding") == dimension, F.col("embedding")).otherwise(F.raise_error(F.lit(f"embedding is not of length {dimension}")).cast("array<float>")))
    both = old.withColumn("_new", F.lit(0)).unionByName(checked.withColumn("_new", F.lit(1)))
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc("_new")))
    return both.withColumn("_r", rank).filter("_r = 1").drop("_r", "_new")


def by_ids(vectors: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return vectors.join(ids.select(key).distinct(), key, "left_semi")


def without_ids(vectors: DataFrame, ids: list | DataFrame, key: str = "id") -> DataFrame:
    """Vectors but those of the given ids; an empty list is an error."""
    if isinstance(ids, list):
        if not ids:
            raise ValueError("no ids given")
        return vectors.filter(~F.col(key).isin(ids))
    return vectors.join(ids.select(key).distinct(), key, "left_anti")


def top_k(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "cosine", query_block: int = QUERY_BLOCK) -> DataFrame:
    """queries(query_id, embedding) x vectors(id, embedding) -> (query_id, id, distance, rank): exact, ties by id.

    Vectors stay where they are read. Queries come to them in blocks of a checked size; a task keeps its
    k best for each query, so only tasks x queries x k rows are shuffled, whatever the number of vectors.
    """
    count = queries.count()
    blocks = max(1, -(-count // query_block))
    tagged = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("_block"))
    out = None
    for block in range(blocks):
        part = tagged.filter(F.col("_block") == block).toPandas() if count else pd.DataFrame({"query_id": [], "embedding": []})
        shared = queries.sparkSession.sparkContext.broadcast((part["query_id"].to_numpy(np.int64), np.array(part["embedding"].tolist(), float).reshape(len(part), -1 if len(part) else 0)))
        found = vectors.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInPandas(_best(shared, k, metric), "query_id long, id long, distance double")
        out = found if out is None else out.unionByName(found)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k)


def _best(shared, k: int, metric: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q = shared.value
        if not len(ids):
            return
        size = np.sqrt((q * q).sum(1))
        best_d, best_i = np.full((len(ids), k), np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
        for batch in batches:
            for s in range(0, len(batch), VECTORS_AT_ONCE):
                part = batch.iloc[s : s + VECTORS_AT_ONCE]
                v, own = np.array(part["embedding"].tolist(), float).reshape(len(part), -1), part["id"].to_numpy(np.int64)
                lengths = (v * v).sum(1)
                for b in range(0, len(ids), QUERIES_AT_ONCE):
                    at = slice(b, b + QUERIES_AT_ONCE)
                    product = q[at] @ v.T
                    if metric == "cosine":
                        norms = size[at, None] * np.sqrt(lengths)[None, :]
                        d = 1 - np.where(norms > 0, product / np.where(norms > 0, norms, 1), 0.0)
                    elif metric == "l2":
                        d = np.maximum((size[at] ** 2)[:, None] + lengths[None, :] - 2 * product, 0)
                    else:
                        d = 1 - product
                    d = np.round(d, 12)
                    # only vectors that are at least as near as a query's k-th best so far need an order
                    nearer = np.flatnonzero((d <= best_d[at, -1:]).any(0))
                    if len(nearer):
                        both_d = np.concatenate([best_d[at], d[:, nearer]], 1)
                        both_i = np.concatenate([best_i[at], np.broadcast_to(own[nearer], (len(d), len(nearer)))], 1)
                        order = np.lexsort((both_i, both_d), axis=1)[:, :k]
                        best_d[at], best_i[at] = np.take_along_axis(both_d, order, 1), np.take_along_axis(both_i, order, 1)
        found = np.isfinite(best_d.ravel())
        if found.any():
            yield pd.DataFrame({"query_id": np.repeat(ids, k)[found], "id": best_i.ravel()[found], "distance": best_d.ravel()[found]})

    return run
