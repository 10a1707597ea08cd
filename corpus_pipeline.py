"""A corpus pipeline over `documents`: five stages, each written as Parquet and read again by the next.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tomeloom.llm import decontamination, mixing, sharding, similarity, toxicity
from tomeloom.llm.common import fresh, stored, table

#: Texts of at least this score go.
TOXIC = 0.5
#: Share of a text's words that benchmark windows may cover. Any hit window contaminates a text.
MAX_HITS = 0

#: The stages hold models and hash draws that SQL can't express; tests/llm compares them with brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that operator 1 scores below TOXIC; it learns from labelled documents of its own input.

    Null and empty texts are ordinary; each of several rows of one id is judged by its own text.
    """
    detector = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    score = fresh(docs, "toxicity")
    return toxicity.score(docs, detector, column=score).filter(F.col(score) < TOXIC).drop(score)


def _keyed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with two hashes of id, source and text, 128 bits by which rows are told apart, and the hashes' names."""
    names = [fresh(docs, "_key_a"), fresh(docs, "_key_b")]
    return docs.withColumns(dict(zip(names, _keys(), strict=True))), names


def _keys() -> list[Column]:
    return [F.xxhash64("doc_id", "source", "text"), F.xxhash64("text", "source", "doc_id", F.lit(1))]


def _matched(docs: DataFrame, names: list[str], found: DataFrame, how: str) -> DataFrame:
    return docs.join(found.withColumnsRenamed(dict(zip("ab", names, strict=True))), names, how)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group that operator 10's links hold together: the one of the least id, nulls last.

    Rows of one id with different texts are judged each by its own; of equal rows one stays. Documents
    without words link to nothing and stay.
    """
    a, b = _keys()
    rows = docs.select("doc_id", "text", F.struct(a.alias("a"), b.alias("b")).alias("key"))
    classes = similarity.similar_rows(rows, carry=["key"])
    none = F.col("class_row").isNull()
    firsts = classes.filter(~none).groupBy("class_row").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("x")).select("x.key", F.lit(False).alias("every_one"))
    stay = firsts.unionByName(classes.filter(none).select("key", F.lit(True).alias("every_one")).distinct()).select("key.*", "every_one")
    rows, names = _keyed(docs)
    turn, every_one = fresh(docs, "_turn"), fresh(docs, "_every_one")
    kept = _matched(rows, names, stay.withColumnRenamed("every_one", every_one), "inner")
    kept = kept.withColumn(turn, F.row_number().over(W.partitionBy(*names).orderBy(F.lit(1))))
    return kept.filter(F.col(every_one) | (F.col(turn) == 1)).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents in which operator 3 finds no window of a benchmark item; rows of one id each by its own text."""
    a, b = _keys()
    rows = docs.select(F.struct(a.alias("a"), b.alias("b")).alias("key"), "text")
    found = decontamination.decontaminate(rows, table(spark, sf_dir, "benchmark"), id_col="key").filter(F.col("n_hit") > MAX_HITS)
    rows, names = _keyed(docs)
    return _matched(rows, names, found.select("doc_id.*").distinct(), "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat each document as often as operator 5 takes it. Equal rows may be taken differently often: each takes one of the counts."""
    a, b = _keys()
    rows = docs.select("doc_id", "source", "text", F.struct(a.alias("a"), b.alias("b")).alias("key"))
    taken = mixing.mix(rows, carry=["key"]).groupBy("key").agg(F.sort_array(F.collect_list("repeats"), asc=False).alias("repeats"))
    rows, names = _keyed(docs)
    turn, repeats, again = fresh(docs, "_turn"), fresh(docs, "_repeats"), fresh(docs, "_again")
    joined = _matched(rows, names, stored(taken.filter("repeats[0] > 0").select("key.*", F.col("repeats").alias(repeats))), "inner")
    joined = joined.withColumn(turn, F.row_number().over(W.partitionBy(*names).orderBy(F.lit(1))))
    times = F.coalesce(F.try_element_at(repeats, F.col(turn)), F.lit(0)).cast("int")
    return joined.withColumn(again, F.explode(F.array_repeat(F.lit(1), times))).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Store the documents by operator 6: doc_id, shard and version of each stored row."""
    store, rows = sharding.shard(docs)
    return rows.select("doc_id", "source", sharding.shard_name(rows).alias("shard"), F.lit(store.version()).alias("version"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", one_of_each),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
