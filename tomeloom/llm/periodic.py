"""Runs of words that repeat with a period (operator 11), found by recursive frequency splitting.

A word of a qualifying run stands in it three times at least. So a word that is rarer than that within a segment
belongs to no run of the segment and splits it; the parts are split again by their own counts until nothing
splits. Few words of ordinary texts survive. The segments left are scanned lag by lag: at lag q a run shows as a
stretch of words equal to those q further on, long enough to hold an aligned block of q positions, so only
multiples of q are looked at, by ids of word sequences as long as the greatest power of two up to q.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, fresh, table

#: A run has so many words and so many periods at least.
LEAST, POWERS = 24, 3
#: Up to this lag all positions are compared; beyond it multiples of the lag.
SHORT = 8


def segments(codes: np.ndarray, least: int = LEAST, powers: int = POWERS) -> list[tuple[int, int]]:
    """(start, end) of what recursive splitting at words rarer than `powers` within their segment leaves."""
    left, todo = [], [(0, len(codes))]
    while todo:
        start, end = todo.pop()
        if end - start < least:
            continue
        _, ids, counts = np.unique(codes[start:end], return_inverse=True, return_counts=True)
        rare = np.flatnonzero(counts[ids] < powers)
        if not len(rare):
            left.append((start, end))
            continue
        edges = np.concatenate(([-1], rare, [end - start]))
        wide = np.flatnonzero(np.diff(edges) > least)
        todo += [(start + int(edges[i]) + 1, start + int(edges[i + 1])) for i in wide]
    return left


def _extended(codes: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The stretch [a, b) around `at` in which each word equals that `lag` further on."""
    a, step = at, 32
    while a:
        differ = np.flatnonzero(codes[max(a - step, 0) : a] != codes[max(a - step, 0) + lag : a + lag])
        if len(differ):
            a = max(a - step, 0) + int(differ[-1]) + 1
            break
        a, step = max(a - step, 0), 2 * step
    b, step, end = at, 32, len(codes) - lag
    while b < end:
        top = min(b + step, end)
        differ = np.flatnonzero(codes[b:top] != codes[b + lag : top + lag])
        if len(differ):
            b += int(differ[0])
            break
        b, step = top, 2 * step
    return a, b


def lag_scan(codes: np.ndarray, least: int = LEAST, powers: int = POWERS) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of the maximal runs of a segment."""
    n, found = len(codes), []
    known = np.empty((0, 3), np.int64)  # start, end, period
    ids, width = codes, 1  # of the sequences of `width` words from each position on
    for lag in range(1, n // powers + 1):
        if lag <= SHORT:
            same = np.concatenate(([0], (codes[:-lag] == codes[lag:]).view(np.int8), [0]))
            turns = np.flatnonzero(np.diff(same))
            stretches = [(int(a), int(b)) for a, b in zip(turns[::2], turns[1::2], strict=True) if b - a + lag >= max(least, powers * lag)]
        else:
            while 2 * width <= lag:
                pairs = ids[:-width].astype(np.int64) * (int(ids.max()) + 1) + ids[width:]
                ids, width = np.unique(pairs, return_inverse=True)[1], 2 * width
            here, there = ids[: len(ids) - lag : lag], ids[lag::lag]
            hits = np.flatnonzero(here == there) * lag
            if not len(hits):
                continue
            for start, end, _ in known[lag % known[:, 2] == 0] if len(known) else ():
                hits = hits[(hits < start) | (hits + lag >= end)]  # that run again, at a multiple of its period
            stretches, upto = [], -1
            for hit in map(int, hits):
                if hit >= upto:
                    a, upto = _extended(codes, hit, lag)
                    stretches.append((a, upto))
        new = []
        for a, b in stretches:
            start, end = a, b + lag
            if end - start >= max(least, powers * lag) and not any(k[0] == start and k[1] == end for k in known):
                new.append((start, end, lag))
        if new:
            found += new
            known = np.concatenate((known, np.array(new, np.int64)))
    return [(start, end - start, lag) for start, end, lag in found]


def runs_of(words: list[bytes], least: int = LEAST, powers: int = POWERS) -> list[tuple[int, int, int]]:
    """(start, length, period) of a text's runs, by start, then period."""
    if len(words) < least:
        return []
    ids: dict[bytes, int] = {}
    codes = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    found = [(start + at, length, lag) for start, end in segments(codes, least, powers) for at, length, lag in lag_scan(codes[start:end], least, powers)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def periodic_runs(documents: DataFrame, text_col: str = "text", least: int = LEAST, powers: int = POWERS) -> DataFrame:
    """documents with n_words, runs (start, length, period; by start, then period) and collapsed added or replaced.

    A run is a stretch of words with smallest period q of max(least, powers * q) words at least that no neighbouring word
    extends. collapsed has the words, joined by one space, without those that a run holds after its first q. Texts are
    judged one by one, whole, in the task that reads them: no shuffle, and memory of a few dozen bytes for each word of the
    longest text. Null and empty texts have no words, no runs and an empty collapsed text; repeated rows stay repeated; an
    empty table stays empty; other columns are kept, whatever their names.
    """

    @F.pandas_udf("n_words long, flat array<long>, collapsed string")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch:
                words = text.encode("utf-8", "surrogatepass").split()
                found = runs_of(words, least, powers)
                n = len(words)
                if found:
                    kept = np.ones(n, bool)
                    for start, length, lag in found:
                        kept[start + lag : start + length] = False
                    words = [words[i] for i in np.flatnonzero(kept)]
                rows.append((n, [x for run in found for x in run], b" ".join(words).decode("utf-8", "surrogatepass")))
            yield pd.DataFrame(rows, columns=["n_words", "flat", "collapsed"])

    held = fresh(documents, "_runs")
    out = documents.withColumn(held, scan(F.coalesce(F.col(text_col), F.lit(""))))
    flat = F.col(f"{held}.flat")
    thirds = F.filter(F.transform(flat, lambda x, i: F.struct(x.alias("start"), F.get(flat, i + 1).alias("length"), F.get(flat, i + 2).alias("period"), (i % 3).alias("_i"))), lambda s: s["_i"] == 0)
    runs = F.transform(thirds, lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length"), s["period"].alias("period")))
    return out.withColumns({"n_words": F.col(f"{held}.n_words"), "runs": runs, "collapsed": F.col(f"{held}.collapsed")}).drop(held)


def strongest(runs: Column) -> Column:
    """Of an array of runs that with the greatest length / period, compared exactly; ties: least start, then period."""

    def order(x: Column, y: Column) -> Column:
        less = F.lit(-1)
        return (
            F.when(x["length"] * y["period"] > y["length"] * x["period"], less).when(x["length"] * y["period"] < y["length"] * x["period"], 1)
            .when(x["start"] < y["start"], less).when(x["start"] > y["start"], 1).when(x["period"] < y["period"], less).when(x["period"] > y["period"], 1).otherwise(0)
        )

    return F.get(F.array_sort(runs, order), F.lit(0))


def with_tails(documents: DataFrame) -> DataFrame:
    """doc_id and text, where the ids that the query's contract names have their texts' tails made periodic."""
    h = F.crc32(F.col("doc_id").cast("string"))
    docs = documents.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, F.filter(F.split("text", SPACES), lambda w: w != "")).alias("words"))
    docs = docs.select("doc_id", "text", "words", F.size("words").alias("n"), F.expr("h DIV 10").alias("g"))
    docs = docs.select("*", F.expr("CAST(g % nullif(n, 0) AS INT)").alias("a")).select("*", F.expr("CAST(1 + (n - a) DIV (3 + g % 8) AS INT)").alias("p"))
    unit = F.slice("words", F.col("a") + 1, F.col("p"))
    tail = F.slice(F.flatten(F.array_repeat(unit, F.expr("CAST((n - a) DIV p + 1 AS INT)"))), F.lit(1), F.col("n") - F.col("a"))
    made = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")
    return docs.select("doc_id", F.when(F.col("n") > 0, made).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark, sf_dir):
    found = periodic_runs(with_tails(table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    best = F.col("best")
    return found.select("doc_id", "runs", "collapsed", strongest(F.col("runs")).alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256")).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("(1000 * best.length) DIV best.period").alias("exponent_milli"), "runs_sha256", F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


SQL = r"""
WITH c AS (SELECT doc_id, text, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda x, k: xor(x >> 1, (x & 1) * 3988292384::UBIGINT))) AS crc FROM documents),
h AS (SELECT row_number() OVER () AS rid, doc_id, xor(crc, 4294967295::UBIGINT)::BIGINT AS h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM c),
g AS (SELECT rid, doc_id, h, h // 10 AS g, ws, len(ws) AS n, CASE WHEN len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM h),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM g),
w AS (SELECT rid, n, i, CASE WHEN h % 10 = 0 AND i >= a THEN ws[1 + a + (i - a) % p] ELSE ws[1 + i] END AS w FROM (SELECT *, unnest(range(n)) AS i FROM p)),
e AS (SELECT x.rid, y.i - x.i AS q, x.i FROM w x JOIN w y ON x.rid = y.rid AND x.w = y.w AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
s AS (SELECT rid, q, i, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS b FROM e),
m AS (SELECT rid, q, min(i) AS s, count(*) + q AS len FROM s GROUP BY rid, q, b HAVING count(*) + q >= greatest(24, 3 * q)),
r AS (SELECT rid, s, len, min(q) AS q FROM m GROUP BY rid, s, len),
f AS (SELECT rid, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM r GROUP BY rid),
k AS (SELECT w.rid, string_agg(w.w, ' ' ORDER BY w.i) AS kept FROM w WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.rid = w.rid AND w.i >= r.s + r.q AND w.i < r.s + r.len) GROUP BY w.rid),
t AS (SELECT rid, s, len, q FROM r QUALIFY row_number() OVER (PARTITION BY rid ORDER BY len::DOUBLE / q DESC, s, q) = 1)
SELECT p.doc_id, coalesce(n_runs, 0) AS n_runs, t.s AS start, t.len AS length, t.q AS period, (1000 * t.len) // t.q AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM p LEFT JOIN f USING (rid) LEFT JOIN k USING (rid) LEFT JOIN t USING (rid)
"""
