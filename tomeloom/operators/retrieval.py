"""Hybrid retrieval: vector and full-text candidates merged, re-ranked, cited and put into context."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.intents import security_intent
from ..functions.security import recency, severity_weight, source_weights
from ..functions.text import snippet

VECTOR_WEIGHT, TEXT_WEIGHT = 0.7, 0.3
VECTOR_POOL, TEXT_POOL = 50, 20


def best(df: DataFrame, k: int, score: str = "score", tie: str = "chunk_id") -> DataFrame:
    """The k best rows of each query, numbered from 1."""
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(score), tie))
    return df.drop("rank").withColumn("rank", rank).filter(F.col("rank") <= k)


def merge(vector_hits: DataFrame | None, text_hits: DataFrame | None, vector_weight: float = VECTOR_WEIGHT, text_weight: float = TEXT_WEIGHT) -> DataFrame:
    """(query_id, chunk_id, distance) and (query_id, chunk_id, rank_score) -> score with both parts; either may be missing.

    A text score counts by its share of the query's best one; a vector score is 1 - distance, never below 0.
    """
    parts = []
    if vector_hits is not None:
        parts.append(vector_hits.select("query_id", "chunk_id", (F.greatest(F.lit(0.0), 1 - F.col("distance")) * vector_weight).alias("vector_score"), F.lit(0.0).alias("fts_score")))
    if text_hits is not None:
        top = F.greatest(F.max("rank_score").over(W.partitionBy("query_id")), F.lit(0.001))
        parts.append(text_hits.select("query_id", "chunk_id", F.lit(0.0).alias("vector_score"), (F.col("rank_score") / top * text_weight).alias("fts_score")))
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    sums = both.groupBy("query_id", "chunk_id").agg(F.sum("vector_score").alias("vector_score"), F.sum("fts_score").alias("fts_score"))
    return sums.withColumn("score", F.round(F.col("vector_score") + F.col("fts_score"), 12))


def lexical_overlap(query: pd.Series, content: pd.Series) -> pd.Series:
    """Default pair scorer: share of the query's words that the content has."""
    words = lambda s: set((s or "").lower().split())
    return pd.Series([len(words(q) & words(c)) / max(1, len(words(q))) for q, c in zip(query, content, strict=True)])


def rerank(hits: DataFrame, scorer: Callable[[pd.Series, pd.Series], pd.Series] = lexical_overlap, k: int | None = None) -> DataFrame:
    """hits(query_id, chunk_id, query, content, score): order by the pair scorer, ties by the old score; the new score
    is 1 - rank / n, rank from 0."""

    @F.pandas_udf("double")
    def pair_score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, c in batches:
            yield scorer(q, c)

    w = W.partitionBy("query_id")
    rows = hits.withColumn("_pair", pair_score("query", "content"))
    rows = rows.withColumn("_at", F.row_number().over(w.orderBy(F.desc("_pair"), F.desc("score"), "chunk_id")) - 1)
    rows = rows.withColumn("score", 1 - F.col("_at") / F.count("*").over(w)).drop("_pair", "_at")
    return rows if k is None else best(rows, k)


def security_rerank(hits: DataFrame, queries: DataFrame, now: Column, k: int, half_life: float | None = 365.0) -> DataFrame:
    """hits(query_id, chunk_id, score, severity, source_type, content_date): the best 3 k by score are weighed by severity,
    recency and the question's source weights, and cut to k. An unknown severity weighs nothing."""
    pool = best(hits, 3 * k)
    intents = queries.select("query_id", security_intent(F.col("query")).alias("intent"))
    weights = F.broadcast(source_weights(hits.sparkSession))
    rows = pool.join(intents, "query_id").join(weights, ["intent", "source_type"], "left")
    score = F.col("score") * severity_weight(F.col("severity")) * recency(F.col("content_date"), now, half_life) * F.coalesce("source_weight", F.lit(1.0))
    return best(rows.withColumn("score", F.round(score, 12)).drop("source_weight"), k)


def citations(hits: DataFrame, n: int = 5) -> DataFrame:
    """At most n sources of each query: snippet, title, chunk and score."""
    return best(hits, n).select("query_id", F.col("rank").alias("source"), "chunk_id", "document_title", snippet(F.col("content")).alias("snippet"), "score")


def contexts(hits: DataFrame, n: int = 5) -> DataFrame:
    """One context text for each query: its n best chunks, numbered and titled."""
    part = F.concat(F.lit("[Source "), F.col("rank").cast("string"), F.lit(": "), F.coalesce("document_title", F.lit("Unknown")), F.lit("]\n"), F.col("content"))
    rows = best(hits, n).select("query_id", F.struct("rank", part.alias("part")).alias("x"))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["part"]), "\n\n---\n\n").alias("context"))


def reused(requests: DataFrame, results: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """requests(key), results(key, value, expires_at, is_error) -> (requests with a live result, requests to compute)."""
    live = results.filter((F.col("expires_at") > now) & ~F.col("is_error"))
    newest = live.groupBy("key").agg(F.max_by("value", "expires_at").alias("value"))
    return requests.join(newest, "key"), requests.join(newest, "key", "left_anti")
