"""Mixing sources to target weights by capped water-filling (operator 5)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE_WORD, count_space_words, stored, table

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_EPOCHS = 2.0
SEED = "mix-1"
#: Hex digits of the order hash that make a slot: a source's rows are summed in 16**3 slots, so that
#: the running sum over one source never needs its rows in one task.
SLOT_DIGITS = 3


def water_fill(sources: DataFrame, total: Column, max_epochs: float) -> DataFrame:
    """Add `target` to sources(source_size, weight): `total` shared by weight, each source held at
    max_epochs x source_size, the excess reshared by weight until none is above.

    Sorting sources by cap over weight makes this one pass: a source is held if the level that fills
    the rest would lie above its cap. There is one row for each source, never one for each document.
    Sources of size 0 get 0. A total of 0 or null gives targets of 0.
    """
    cap = F.lit(max_epochs) * F.col("source_size")
    order = [cap / F.col("weight"), F.col("source").asc_nulls_last()]
    before = W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    rest = W.orderBy(*order).rowsBetween(W.currentRow, W.unboundedFollowing)
    level = (total - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    leveled = sources.withColumn("_level", F.greatest(level, F.lit(0.0))).withColumn("_free", F.col("_level") <= cap / F.col("weight"))
    # past the first free source all are free, at the first one's level
    free = leveled.withColumn("_first", F.min_by(F.when(F.col("_free"), F.col("_level")), F.when(F.col("_free"), cap / F.col("weight"))).over(W.partitionBy(F.lit(1))))
    target = F.least(cap, F.coalesce(F.col("_first") * F.col("weight"), cap))
    return free.withColumn("target", F.coalesce(target, F.lit(0.0))).drop("_level", "_free", "_first")


def mix(documents: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: str = SEED, carry: Sequence[str] = ()) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target (of its source), taken, repeats, and the columns of `carry`.

    Sources in code point order, null last, get `weights` in turn. A source's target over its size is
    its epochs: every document is taken the whole number of times, and the fraction is a seeded draw
    of documents whose sizes come as near to the rest as one document allows. Null texts have size 0;
    a null source is a source; null or repeated ids are drawn by their texts, so they spread over all slots; equal rows are
    told apart by nothing, so any of them may be the one drawn. An empty table gives an empty result.
    """
    size = count_space_words(F.col(text_col))
    order_hash = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.coalesce(F.col(text_col), F.lit(""))).cast("binary"))
    rows = stored(documents.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), order_hash.alias("_h"), F.struct(F.lit(0).alias("none"), *carry).alias("_carried")))
    slot = F.substring("_h", 1, SLOT_DIGITS)
    slots = stored(rows.groupBy("source", slot.alias("_slot")).agg(F.sum("size").alias("_slot_size")))
    sources = slots.groupBy("source").agg(F.sum("_slot_size").alias("source_size"))
    turn = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    sources = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), turn + 1))
    total = F.sum("source_size").over(W.partitionBy(F.lit(1))) * share
    targets = water_fill(sources.withColumn("_total", total), F.col("_total"), max_epochs).drop("_total")
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(epochs)
    targets = targets.withColumn("_whole", whole).withColumn("_goal", F.col("target") - whole * F.col("source_size"))
    targets = targets.select(F.col("source").alias("_source"), "source_size", "weight", "target", "_whole", "_goal")
    # what each slot takes: all below the cut, none above it; rows meet their slot, never their whole source
    before = F.coalesce(F.sum("_slot_size").over(W.partitionBy("source").orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    slots = slots.withColumn("_before", before).join(targets, F.col("source").eqNullSafe(F.col("_source")))
    slots = slots.withColumn("_side", F.when(F.col("_before") + F.col("_slot_size") <= F.col("_goal"), 1).when(F.col("_before") > F.col("_goal"), -1).otherwise(0))
    slots = slots.select("_source", F.col("_slot").alias("_s"), "source_size", "target", "_whole", "_goal", "_before", "_side")
    rows = rows.join(slots, F.col("source").eqNullSafe(F.col("_source")) & (slot == F.col("_s")))
    # only rows of the slot that holds the cut need an order
    at_cut = rows.filter("_side = 0")
    run = F.coalesce(F.sum("size").over(W.partitionBy("source", "_s").orderBy("_h", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    at_cut = at_cut.withColumn("_extra", ((F.col("_goal") > 0) & (F.col("_before") + run + F.col("size") / 2 <= F.col("_goal"))).cast("long"))
    others = rows.filter("_side <> 0").withColumn("_extra", ((F.col("_goal") > 0) & (F.col("_side") > 0)).cast("long"))
    out = at_cut.unionByName(others).withColumn("repeats", (F.col("_whole") + F.col("_extra")).cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"), "repeats", *[F.col(f"_carried.{c}").alias(c) for c in carry])


def op5_mix(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = f"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{SPACE_WORD}')), 0) AS BIGINT) AS size,
         md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(text, '')) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS weight FROM s),
l AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
         greatest(0, (CAST((SELECT sum(source_size) FROM s) AS DOUBLE) * 1.5::DOUBLE
           - coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(weight) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level
  FROM w),
t AS (
  SELECT source, source_size, least(cap, coalesce((SELECT min_by(level, cap / weight) FROM l WHERE level <= cap / weight) * weight, cap)) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
r AS (
  SELECT d.doc_id, d.size, e.source_size, e.target, e.whole, e.target - e.whole * e.source_size AS goal,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN goal > 0 AND run + size / 2.0::DOUBLE <= goal THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""
