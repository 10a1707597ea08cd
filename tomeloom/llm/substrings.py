"""Substring deduplication by De Bruijn compaction (operator 8).

The edges of the graph are token k-mers: windows of `k` words. They are never shuffled one by one.
Consecutive edges of a text whose least m-mer is the same form one path segment, about (k - m) / 2
edges long, that names its anchor, that m-mer. Equal edges have equal anchors, so:

1. Only anchors of two documents or more can lead to repeated edges; the rest is dropped by a join.
2. Equal segments of an anchor are one compacted path. Where an anchor has one path, no branch, all its
   edges first stand in the path's least document. Where paths branch at an anchor, the edges of one
   copy of each path are compared, and runs of edges with one origin compact again.
3. Paths are joined to their occurrences and merge into long spans with source coordinates; a second
   reading of both places verifies every span before it is removed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE_WORD, stored, table, table_name, work_dir
from .hashing import HASHER, Rolling, mixed, signed, sliding_min

WINDOW = 50
ANCHOR = 16
LAST = 2**63 - 1

split_words = re.compile(SPACE_WORD).findall


class _Segments:
    """The path segments of one text: anchor, first edge and number of edges of each."""

    def __init__(self, words: list[str], k: int, m: int):
        self.rolling = Rolling(HASHER.codes(words))
        least = sliding_min(self.rolling.windows(m), k - m + 1)
        turns = np.flatnonzero(least[1:] != least[:-1]) + 1
        self.start = np.concatenate([np.zeros(1, np.int64), turns]) if len(least) else np.zeros(0, np.int64)
        self.anchor = signed(least[self.start])
        self.count = np.diff(np.append(self.start, len(least)))


def _frame(columns: dict[str, list[np.ndarray]]) -> pd.DataFrame:
    return pd.DataFrame({name: np.concatenate(parts) for name, parts in columns.items()})


def _anchors(k: int, m: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = {"a": [], "d": [], "t": []}
            for d, t, text in zip(batch["d"], batch["t"], batch["text"], strict=True):
                words = split_words(text)
                if len(words) >= k:
                    anchors = np.unique(_Segments(words, k, m).anchor)
                    out["a"].append(anchors)
                    out["d"].append(np.full(len(anchors), d, np.int64))
                    out["t"].append(np.full(len(anchors), t, np.int64))
            if out["a"]:
                yield _frame(out)

    return run


def _occurrences(k: int, m: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = {x: [] for x in ("a", "n", "s", "d", "t", "start")}
            for d, t, text, repeated in zip(batch["d"], batch["t"], batch["text"], batch["anchors"], strict=True):
                segs = _Segments(split_words(text), k, m)
                at = np.flatnonzero(np.isin(segs.anchor, np.asarray(repeated, np.int64)))
                start, count = segs.start[at], segs.count[at]
                path = signed(segs.rolling.spans(start, start + count + k - 1))
                for name, part in zip(out, (segs.anchor[at], count, path, np.full(len(at), d, np.int64), np.full(len(at), t, np.int64), start), strict=True):
                    out[name].append(part)
            yield _frame(out)

    return run


def _edges(k: int):
    """The edges of the listed segments, with their place in the segment."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = {x: [] for x in ("w1", "w2", "a", "n", "s", "off", "d", "t", "pos")}
            for d, t, text, asked in zip(batch["d"], batch["t"], batch["text"], batch["asked"], strict=True):
                codes = HASHER.codes(split_words(text))
                first, second = Rolling(codes).windows(k), Rolling(mixed(codes + np.uint64(1))).windows(k)
                start, n, a, s = (np.array([x[name] for x in asked], np.int64) for name in ("start", "n", "a", "s"))
                off = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at = np.repeat(start, n) + off
                for name, part in zip(out, (signed(first[at]), signed(second[at]), np.repeat(a, n), np.repeat(n, n), np.repeat(s, n), off, np.full(len(at), d, np.int64), np.full(len(at), t, np.int64), at), strict=True):
                    out[name].append(part)
            yield _frame(out)

    return run


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for d, t, text, asked in zip(batch["d"], batch["t"], batch["text"], batch["asked"], strict=True):
            words = split_words(text)
            for x in asked:
                span = " ".join(words[x["start"] : x["start"] + x["len"]])
                out.append((d, t, x["start"], x["len"], xxhash.xxh3_128_hexdigest(span)))
        yield pd.DataFrame(out, columns=["d", "t", "start", "len", "digest"])


def _removed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for d, t, text, asked in zip(batch["d"], batch["t"], batch["text"], batch["asked"], strict=True):
            words = split_words(text)
            gone = np.zeros(len(words) + 1, np.int64)
            for x in asked:
                gone[x["start"]] += 1
                gone[x["start"] + x["len"]] -= 1
            gone = np.cumsum(gone[:-1]) > 0
            kept = " ".join(w for w, x in zip(words, gone.tolist(), strict=True) if not x)
            out.append((d, t, int(gone.sum()), kept))
        yield pd.DataFrame(out, columns=["d", "t", "n_removed", "kept"])


def _bucketed(df: DataFrame, *keys: str) -> DataFrame:
    """Write df bucketed by the keys in the shared folder, so that later joins by them move only their other side."""
    spark = df.sparkSession
    path = work_dir(spark)
    name = table_name(path)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(parts, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    return spark.table(name)


def _asking(texts: DataFrame, asked: DataFrame, fields: list[str]) -> DataFrame:
    """texts with the array `asked` of the rows of asked(d, t, *fields) for each."""
    lists = asked.groupBy("d", "t").agg(F.collect_list(F.struct(*fields)).alias("asked")).withColumnRenamed("d", "_d").withColumnRenamed("t", "_t")
    return texts.join(lists, (F.col("d") == F.col("_d")) & (F.col("t") == F.col("_t"))).select("d", "t", "text", "asked")


def repeated_spans(rows: DataFrame, k: int = WINDOW, m: int = ANCHOR) -> tuple[DataFrame, DataFrame]:
    """rows(d, t, text) -> (texts that may hold repeats, spans(d, t, start, len, src_d, src_t, src_start)).

    A span is a run of words all covered by k-word windows that also start in a row of smaller d, the
    least such row; coordinates are word positions. Every span has been compared with its source.
    """
    m = min(m, k)
    # a row is told by id and text, so that the many rows without an id don't meet
    anchors = stored(rows.select("d", "t", "text").mapInPandas(_anchors(k, m), "a long, d long, t long"))
    repeated = anchors.groupBy("a").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).filter("lo < hi").select("a")
    lists = anchors.join(repeated, "a").groupBy("d", "t").agg(F.collect_set("a").alias("anchors")).withColumnsRenamed({"d": "_d", "t": "_t"})
    texts = _bucketed(rows.join(lists, (F.col("d") == F.col("_d")) & (F.col("t") == F.col("_t"))).select("d", "t", "text", "anchors"), "d", "t")

    path = ["a", "n", "s"]
    seen = stored(texts.mapInPandas(_occurrences(k, m), "a long, n long, s long, d long, t long, start long"))
    paths = stored(seen.groupBy(*path).agg(F.min(F.struct("d", "t", "start")).alias("src")).select(*path, "src.*"))
    # written too, for anchors of many paths
    branches = stored(paths.groupBy("a").agg(F.count("*").alias("paths"), F.min("d").alias("lo"), F.max("d").alias("hi")))
    marked = stored(paths.join(branches, "a"))
    straight = marked.filter("paths = 1").select(*path, F.lit(0).cast("long").alias("off"), F.col("n").alias("edges"), F.col("d").alias("src_d"), F.col("t").alias("src_t"), F.col("start").alias("src_pos"))
    asked = _asking(texts, marked.filter("paths > 1"), ["start", *path])
    edges = stored(asked.mapInPandas(_edges(k), "w1 long, w2 long, a long, n long, s long, off long, d long, t long, pos long"))
    # written first: edges of a frequent window then meet its one origin in a join that is split where they are many
    origins = stored(edges.groupBy("w1", "w2").agg(F.min(F.struct("d", "t", "pos")).alias("o")))
    origin = edges.select("w1", "w2", *path, "off").join(origins, ["w1", "w2"]).select(*path, "off", "o.*").withColumn("diagonal", F.col("pos") - F.col("off"))
    island = F.col("off") - F.row_number().over(W.partitionBy(*path, "d", "t", "diagonal").orderBy("off"))
    branched = origin.withColumn("island", island).groupBy(*path, "d", "t", "diagonal", "island").agg(F.min("off").alias("off"), F.count("*").alias("edges"), F.min("pos").alias("src_pos"))
    branched = branched.select(*path, "off", "edges", F.col("d").alias("src_d"), F.col("t").alias("src_t"), "src_pos")
    runs = straight.unionByName(branched)

    spans = seen.join(runs, path).filter(F.col("src_d") < F.col("d"))
    spans = spans.select("d", "t", (F.col("start") + F.col("off")).alias("start"), "edges", "src_d", "src_t", "src_pos")
    spans = spans.withColumn("diagonal", F.col("start") - F.col("src_pos")).distinct()
    # neighbouring runs of one source and diagonal are one path
    w = W.partitionBy("d", "t", "src_d", "src_t", "diagonal").orderBy("start")
    reach = F.max(F.col("start") + F.col("edges")).over(w.rowsBetween(W.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1)).withColumn("span", F.sum("new").over(w))
    spans = spans.groupBy("d", "t", "src_d", "src_t", "diagonal", "span").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("edges")).alias("end"))
    spans = stored(spans.select("d", "t", "start", (F.col("end") - F.col("start") + (k - 1)).alias("len"), "src_d", "src_t", (F.col("start") - F.col("diagonal")).alias("src_start")))

    places = spans.select("d", "t", "start", "len").union(spans.select("src_d", "src_t", "src_start", "len")).distinct()
    digests = stored(_asking(texts, places, ["start", "len"]).mapInPandas(_digests, "d long, t long, start long, len long, digest string"))
    here = digests.withColumnRenamed("digest", "here")
    there = digests.select(F.col("d").alias("src_d"), F.col("t").alias("src_t"), F.col("start").alias("src_start"), "len", F.col("digest").alias("there"))
    checked = spans.join(here, ["d", "t", "start", "len"]).join(there, ["src_d", "src_t", "src_start", "len"]).filter(F.col("here") == F.col("there")).drop("here", "there")
    return texts, checked


def remove_repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WINDOW, m: int = ANCHOR) -> DataFrame:
    """Per document row: doc_id, n_words, n_removed, kept (words joined by one space).

    Words covered by a window of k words whose sequence also starts in a row of smaller doc_id go.
    Null texts have no words; null ids come after all others; rows of one id never remove each other's
    words and are told apart by their texts. Texts under k words stay whole. Empty tables give none.
    """
    rows = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("d"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("t", F.xxhash64("text"))
    changed = _changed(rows, k, m).select(F.col("d").alias("_d"), F.col("t").alias("_t"), "n_removed", F.col("kept").alias("_kept"))
    words = F.regexp_extract_all("text", F.lit(SPACE_WORD), F.lit(0))
    out = rows.join(changed, (F.col("d") == F.col("_d")) & (F.col("t") == F.col("_t")), "left")
    return out.select("doc_id", F.size(words).cast("long").alias("n_words"), F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("_kept", F.array_join(words, " ")).alias("kept"))


def _changed(rows: DataFrame, k: int, m: int) -> DataFrame:
    texts, spans = repeated_spans(rows, k, m)
    changed = _asking(texts, spans, ["start", "len"]).mapInPandas(_removed, "d long, t long, n_removed long, kept string")
    return changed.dropDuplicates(["d", "t"])


def op8_remove_repeats(spark, sf_dir):
    """As remove_repeats(), but the texts that keep all words are digested where they are read: only
    digests meet the changed ones."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"), F.coalesce("text", F.lit("")).alias("text")).withColumn("t", F.xxhash64("text"))
    words = F.regexp_extract_all("text", F.lit(SPACE_WORD), F.lit(0))
    whole = rows.select("doc_id", "d", "t", F.size(words).cast("long").alias("n_words"), F.sha2(F.array_join(words, " "), 256).alias("whole_sha256"))
    changed = _changed(rows, WINDOW, ANCHOR).select(F.col("d").alias("_d"), F.col("t").alias("_t"), "n_removed", F.sha2("kept", 256).alias("_sha256"))
    out = whole.join(changed, (F.col("d") == F.col("_d")) & (F.col("t") == F.col("_t")), "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("_sha256", "whole_sha256").alias("kept_sha256"))


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '{SPACE_WORD}'), []) AS ws FROM documents),
w AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(ws, i, i + {WINDOW - 1}), ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM d WHERE len(ws) >= {WINDOW})),
f AS (SELECT h, min(doc_id) AS first_doc FROM w GROUP BY h),
g AS (SELECT doc_id, i FROM w JOIN f USING (h) WHERE first_doc < doc_id),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM g),
r AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN n IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(ps, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""
