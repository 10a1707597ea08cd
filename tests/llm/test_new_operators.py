"""Periodic runs, collocations and quality rules against brute force, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tomeloom.llm import periodic, phrases, quality

WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, lang string, source string, runs string, _statistics string, stratum string"


def frame(spark, rows):
    """rows of (doc_id, text, lang), with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, lang, "s", "x", "y", "z") for i, t, lang in rows], SCHEMA)


def plain_runs(words, least=24, powers=3):
    """Every lag, every stretch; a stretch counts at its smallest period."""
    found, n = {}, len(words)
    for lag in range(1, n // powers + 1):
        i = 0
        while i + lag < n:
            j = i
            while j + lag < n and words[j] == words[j + lag]:
                j += 1
            if j - i + lag >= max(least, powers * lag):
                found.setdefault((i, j - i + lag), lag)
            i = max(j, i + 1)
    return sorted(((s, length, lag) for (s, length), lag in found.items()), key=lambda r: (r[0], r[2]))


@settings(max_examples=150, deadline=None)
@given(st.randoms(use_true_random=False), st.integers(1, 4), st.integers(0, 160))
def test_runs_equal_all_lags(rng, kinds, n):
    words, left = [], n
    while left > 0:
        unit = [rng.choice("abcdefgh"[: 2 * kinds]).encode() for _ in range(rng.randint(1, 14))]
        part = (unit * 9)[: rng.randint(1, 60)] if rng.random() < 0.6 else [f"x{rng.randint(0, 99)}".encode() for _ in range(rng.randint(1, 9))]
        words += part
        left -= len(part)
    for least, powers in ((24, 3), (6, 3), (8, 4)):
        assert periodic.runs_of(words, least, powers) == (plain_runs(words, least, powers) if len(words) >= least else [])


def test_runs_of_one_word_and_long_texts():
    assert periodic.runs_of([b"a"] * 30_000) == [(0, 30_000, 1)]
    unit = [f"w{i}".encode() for i in range(7000)]
    assert periodic.runs_of([b"z"] + unit * 3 + [b"z"]) == [(1, 21_000, 7000)]
    rng = random.Random(2)
    assert periodic.runs_of([f"w{int(rng.paretovariate(0.6))}".encode() for _ in range(100_000)]) == []


def test_segments_split_at_rare_words():
    codes = np.array([1] * 30 + [2] + [3, 4] * 15 + [5] * 2 + [1] * 30)
    assert sorted(periodic.segments(codes)) == [(0, 30), (31, 61), (63, 93)]


def test_periodic_query_equals_brute_force(spark, sf):
    got = {r.doc_id: r for r in periodic.op11_periodic_runs(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    runs = 0
    for d in docs:
        words, h = re.findall(WORD, d.text or ""), zlib.crc32(str(d.doc_id).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        want = plain_runs(words) if n < 1500 else periodic.runs_of([w.encode() for w in words])
        gone = {i for s, length, lag in want for i in range(s + lag, s + length)}
        r, best = got[d.doc_id], min(want, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period) == (len(want), *best)
        assert r.exponent_milli == (None if best[0] is None else 1000 * best[1] // best[2])
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{length},{lag}\n" for s, length, lag in want).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest()
        runs += len(want)
    assert runs > 5


def test_periodic_edges(spark):
    rows = [(1, None, "en"), (1, "", None), (None, "a b " * 20, "en"), (2, " \n\x0b ", "en"), (2, "a b " * 20, "en"), (3, "é " * 24, "en"), (4, "a " * 23, "en")]
    out = periodic.periodic_runs(frame(spark, rows))
    assert set(SCHEMA.replace(" long", "").replace(" string", "").split(", ")) | {"n_words", "collapsed"} == set(out.columns)
    got = sorted((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in out.collect())
    assert got == sorted([(1, 0, [], ""), (1, 0, [], ""), (0, 40, [(0, 40, 2)], "a b"), (2, 0, [], ""), (2, 40, [(0, 40, 2)], "a b"), (3, 24, [(0, 24, 1)], "é"), (4, 23, [], " ".join("a" * 23))])
    assert periodic.periodic_runs(frame(spark, [])).count() == 0
    tie = spark.sql("SELECT array(named_struct('start', 9L, 'length', 30L, 'period', 2L), named_struct('start', 4L, 'length', 60L, 'period', 4L), named_struct('start', 4L, 'length', 45L, 'period', 3L)) AS runs")
    assert tuple(tie.select(periodic.strongest(F.col("runs")).alias("r")).first().r) == (4, 45, 3)
    assert [r.text for r in periodic.with_tails(frame(spark, [(None, "a b", "en"), (5, None, "en")])).collect()] == ["a b", None]


def plain_collocations(rows, least, top):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = (text or "").encode().lower().decode()
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            f.update((lang, tuple(ws[i : i + k])) for k in range(1, 6) for i in range(len(ws) - k + 1))
    cands = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    out = {}
    for (lang, p), a in cands.items():
        longer = [b for (other, q), b in cands.items() if other == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
        if any(100 * b >= 100 * a for b in longer):
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]], n[lang]))
    return sorted((lang, rank, p.decode(), -a, left, right, n, -s) for lang, found in out.items() for rank, (s, a, p, left, right, n) in enumerate(sorted(found)[:top], 1))


def phrase_rows(seed, n=260):
    rng = random.Random(seed)
    words = ["the", "of", "New", "york", "city", "É", "éa", "b#", "x\x00y"] + [f"w{i}" for i in range(30)]
    weights = [20, 15, 9, 9, 8, 5, 5, 4, 4] + [1] * 30
    rows = []
    for _ in range(n):
        text = []
        for w in rng.choices(words, weights, k=rng.randint(0, 60)):
            text += ["New York", "city"] if w == "New" and rng.random() < 0.5 else [w]
        rows.append((rng.choice(["en", "en", "en", None, "fr"]), re.sub(r" (?=w1)", lambda _: rng.choice([". ", "\n", "\t", "  ", "; "]), " ".join(text))))
    return [*rows, ("en", None), (None, ""), ("en", " ... "), ("und", "the of new york city " * 12), ("en", "spam " * 300)]


def collected(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


@pytest.mark.parametrize("change", [{}, {"BLOCK": 40}, {"HELD": 50}, {"MOST": 20, "ROWS": 4, "EVERY": 1}, {"MOST": 20, "ROWS": 4, "EVERY": 1, "BLOCK": 30, "HELD": 200}, {"_word_bits": lambda words: np.full(1 << (phrases.BITS - 3), 255, np.uint8)}])
def test_collocations_equal_brute_force(spark, monkeypatch, change):
    """With limits that make blocks, several rounds in a task, hot phrases routed by more words, and a filter that lets rare words by."""
    for k, v in change.items():
        monkeypatch.setattr(phrases, k, v)
    if "BLOCK" in change:
        monkeypatch.setattr(phrases.phrase_counts, "__defaults__", (phrases.LEAST, change["BLOCK"], 30 if "MOST" in change else None))
    rows = phrase_rows(5)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    assert collected(phrases.collocations(df, least=8, top=25)) == plain_collocations(rows, 8, 25) != []


def test_collocations_edges(spark):
    none = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(none).count() == 0
    assert phrases.collocations(spark.createDataFrame([(None, None), ("en", "a b")], "lang string, text string")).count() == 0
    big = spark.range(3).select(F.lit("en").alias("lang"), F.lit("A b! " * 200).alias("text"))
    assert collected(phrases.collocations(big)) == [("en", 1, "a b", 600, 600, 600, 1200, 2000)]


def test_three_way_counts_and_abandons():
    codes = np.array([[1, 3, 4, 5, 0, 0], [1, 3, 4, 6, 0, 0], [1, 3, 4, 0, 0, 0], [1, 3, 7, 0, 0, 0], [2, 3, 4, 5, 0, 0]], np.int32)
    found = {tuple(c): n for c, n in phrases.three_way(codes, np.array([2, 3, 4, 1, 1]), np.full(5, 2), 3)}
    assert found == {(1, 3, 4): 9, (1, 3, 4, 6): 3}


def plain_statistics(text):
    words = re.findall(WORD, text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    repeated = {i + j for i, w in enumerate(windows) if counts[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab é#|\n\t\x0b%", max_size=120))
def test_statistics_equal_brute_force(text):
    got = dict(zip(quality.STATISTICS, quality._statistics_of(text), strict=True))
    assert tuple(got[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == plain_statistics(text)


def test_quality_query_statistics(spark, sf):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = quality.op13_quality(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_statistics(docs[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)


@pytest.mark.parametrize("n, k, p", [(10, 0, 0.05), (10, 2, 0.5), (200, 3, 0.05), (57, 30, 0.4), (900, 10, 0.01), (5, 5, 0.3), (40, 39, 0.9)])
def test_tail_is_the_binomial_sum(n, k, p):
    assert math.isclose(quality.tail(n, k, p), sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), rel_tol=1e-9)


def labelled(spark, n, bad_share=0.2, symbols_in_good=0.0, lang="en", seed=1, start=0):
    """Statistics of n rows and their labels: bad rows have symbols, good ones some of them too."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(start, start + n):
        bad = rng.random() < bad_share
        symbols = rng.randint(40, 90) if bad else rng.randint(30, 95) if rng.random() < symbols_in_good else 0
        rows.append((i, lang, 100, 500 + rng.randint(-20, 20), symbols, 10, 0, 0, False))
        labels.append((i, int(not bad)))
    return rows, labels


STATISTICS = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, base_failed boolean"


def test_cutoffs_are_certified(spark):
    rows, labels = labelled(spark, 1500)
    more, more_labels = labelled(spark, 40, lang="few", start=10_000)
    df, marks = spark.createDataFrame(rows + more, STATISTICS), spark.createDataFrame(labels + more_labels, "doc_id long, quality int")
    found = quality.cutoffs(df, marks).collect()
    assert [r.stratum for r in found] == ["en"] and found[0].symbols < 400 and found[0].n_rejected == 0
    assert found[0].p_value * found[0].n_strata <= quality.CHANCE and math.isclose(found[0].p_value, 0.95 ** found[0].n_held_out)
    verdicts = {r.doc_id: r.kept for r in quality.judged(df, quality.cutoffs(df, marks)).collect()}
    assert all(verdicts[i] == bool(q) for i, q in labels) and all(verdicts[i] for i, _ in more_labels)


def test_false_rejections_stay_below_the_risk(spark):
    """A tenth of the good rows look bad: no cutoff that rejects them is certified, in no draw of labels."""
    for seed in range(2):
        rows, labels = labelled(spark, 1500, symbols_in_good=0.1, seed=seed)
        df, marks = spark.createDataFrame(rows, STATISTICS), spark.createDataFrame(labels, "doc_id long, quality int")
        kept = {r.doc_id: r.kept for r in quality.judged(df, quality.cutoffs(df, marks)).collect()}
        good = [i for i, q in labels if q]
        assert sum(not kept[i] for i in good) <= quality.RISK * len(good)


def test_quality_edges(spark):
    rows = [(1, None, "en"), (None, "", None), (2, "a b c " * 40, "en"), (2, "a b c " * 40, "en"), (3, " ".join(f"w{i}" for i in range(60)), None), (4, "x " * 49, "en")]
    read = quality.with_statistics(frame(spark, rows))
    none = spark.createDataFrame([], "doc_id long, quality int")
    odd = spark.createDataFrame([(None, 1), (3, None), (2, 1), (2, 0)], "doc_id long, quality int")
    for labels in (none, odd):
        out = quality.judged(read, quality.cutoffs(read, labels))
        got = sorted((r.doc_id or 0, r.n_words, r.base_failed, r.kept) for r in out.collect())
        assert got == sorted([(1, 0, True, False), (0, 0, True, False), (2, 120, True, False), (2, 120, True, False), (3, 60, False, True), (4, 49, True, False)])
        assert {"runs", "_statistics", "stratum"} <= set(out.columns)
    empty = quality.with_statistics(frame(spark, []))
    assert quality.judged(empty, quality.cutoffs(empty, odd)).count() == 0
