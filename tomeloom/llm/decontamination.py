"""Benchmark decontamination: prefix-filtered set join of shingles (operator 3). DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import LETTER_WORD, letter_words, stored, table

WINDOW = 10
SHINGLE = 5
#: Prefix rows that are broadcast at most (about 100 MB); beyond it the join shuffles.
BROADCAST_ROWS = 200_000


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(item_id, w): the distinct word windows of each item; an item of fewer words, but not none, is one."""
    words = items.select(F.col(id_col).cast("string").alias("item_id"), letter_words(F.col(text_col)).alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (window - 1), F.lit(1)))
    return words.select("item_id", F.explode(F.array_distinct(F.transform(starts, lambda i: F.slice(F.col("words"), i, window)))).alias("w")).distinct()


def token_rows(words: Column, size: Column | int) -> Column:
    """Hashes of all runs of `size` words, by position; none where there are fewer words."""
    n = F.size(words)
    return F.when(n >= size, F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, size)))).otherwise(F.array().cast("array<bigint>"))


def prefixes(windows: DataFrame, counts: DataFrame | None, size: int) -> DataFrame:
    """(h, at, w): for each distinct window its necessary prefix under rarity order.

    Containment of the whole window needs all of its shingles, so the prefix is one shingle: the rarest
    by `counts`(h, n), an uncounted one first, then by hash. `at` is its offset in the window.
    """
    tokens = windows.select("w", F.posexplode(token_rows(F.col("w"), size)).alias("at", "h"))
    if counts is not None:
        tokens = tokens.join(counts, "h", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    else:
        tokens = tokens.withColumn("n", F.lit(0))
    return tokens.groupBy("w").agg(F.min(F.struct("n", "h", "at")).alias("t")).select("t.h", "t.at", "w")


def decontaminate(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, shingle: int = SHINGLE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, items (sorted strings of the items with a window in it).

    Tokens are shingles of `shingle` words (a shorter window is its own only shingle). Each window joins
    on its rarest shingle, rarity taken over all documents; a match must leave room for the window at
    both ends (positional and length bounds) and is verified word by word in the document. Windows
    shared by items join once. Null texts have no words, null ids of documents are kept; repeated ids
    share the hits of their texts' union only if the texts are equal: rows are told apart by id and
    text. Null item ids are left out; no items or no documents give zero hits or an empty result.
    """
    docs = documents.select(F.col(id_col).alias("doc_id"), letter_words(F.col(text_col)).alias("words"))
    key = [F.col("doc_id"), F.xxhash64("words").alias("text_key"), F.size("words").cast("long").alias("n_words")]
    item_rows = stored(item_windows(items.filter(F.col(item_id_col).isNotNull()), item_id_col, item_text_col, window))
    windows = item_rows.select("w").distinct()
    # window sizes from 1 to `shingle` need a token size of their own; at most `shingle` values
    sizes = sorted(r[0] for r in windows.select(F.least(F.size("w"), F.lit(shingle)).alias("s")).distinct().collect())
    hits = None
    for size in sizes:
        of_size = windows.filter(F.least(F.size("w"), F.lit(shingle)) == size)
        wanted = of_size.select(F.explode(token_rows(F.col("w"), size)).alias("h")).distinct()
        small = wanted.count() <= broadcast_rows
        hint = F.broadcast if small else (lambda df: df)
        tokens = docs.select(F.explode(token_rows(F.col("words"), size)).alias("h"))
        counts = tokens.join(hint(wanted), "h", "left_semi").groupBy("h").agg(F.count("*").alias("n"))
        prefix = stored(prefixes(of_size, counts, size))
        if small:
            found = docs.select("doc_id", "words", F.posexplode(token_rows(F.col("words"), size)).alias("pos", "h")).join(F.broadcast(prefix), "h")
        else:
            spots = docs.select("doc_id", F.xxhash64("words").alias("text_key"), F.posexplode(token_rows(F.col("words"), size)).alias("pos", "h")).join(prefix, "h")
            found = spots.join(docs.withColumn("text_key", F.xxhash64("words")).withColumnRenamed("doc_id", "_id"), (F.col("doc_id").eqNullSafe(F.col("_id"))) & (spots["text_key"] == F.xxhash64("words"))).drop("_id", "text_key")
        start, length = F.col("pos") - F.col("at"), F.size("w")
        found = found.filter((start >= 0) & (start + length <= F.size("words")))
        found = found.filter(F.slice("words", start + 1, length) == F.col("w"))
        found = found.select("doc_id", F.xxhash64("words").alias("text_key"), start.alias("start"), (start + length).alias("end"), "w")
        hits = found if hits is None else hits.unionByName(found)
    rows = docs.select(*key)
    if hits is None:
        return rows.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"))
    hits = stored(hits.distinct())
    # words covered: each start adds what lies beyond the end reached before it
    reached = F.max("end").over(W.partitionBy("doc_id", "text_key").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce(reached, F.lit(0))))
    covered = hits.select("doc_id", "text_key", "start", "end").distinct().withColumn("fresh", fresh)
    covered = covered.groupBy("doc_id", "text_key").agg(F.sum("fresh").cast("long").alias("n_hit"))
    named = hits.select("doc_id", "text_key", "w").distinct().join(item_rows, "w").select("doc_id", "text_key", "item_id").distinct()
    named = named.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list("item_id")).alias("items"))
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_key"] == b["text_key"])
    covered = covered.join(named, same(covered, named)).select(covered["doc_id"], covered["text_key"], "n_hit", "items")
    out = rows.join(covered, same(rows, covered), "left")
    return out.select(rows["doc_id"], "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def op3_decontaminate(spark, sf_dir):
    rows = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '{LETTER_WORD}') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({_LOWERED}, '{LETTER_WORD}') AS ws FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, list_slice(ws, i, i + 9) AS w
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
ns AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT doc_id, i, n, list_slice(ws, i, i + n - 1) AS w
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, ns WHERE len(ws) >= n)),
h AS (SELECT dw.doc_id, dw.i, dw.n, iw.item_id FROM dw JOIN iw ON dw.w = iw.w),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
