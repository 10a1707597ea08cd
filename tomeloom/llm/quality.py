"""Quality rules whose cutoffs have a certified risk (operator 13).

Each rule compares one statistic of a text with a cutoff. Labelled rows are dealt by a hash of their id into fit
rows and held-out rows. In every stratum (language) the good fit rows give each rule a path of cutoffs, from one
that no good fit row passes to ever stricter ones. Rules take turns, the one that tells fit rows best first: the first
set to be tested is that rule at its mildest cutoff, the next adds the second rule, and after the last the first rule
takes its second cutoff. Held-out good rows test these sets in order: a set is certified if so few of them are
rejected that the exact binomial (Clopper-Pearson) upper bound of the share of good texts rejected is at most
`risk`, at a confidence corrected for the number of strata (Bonferroni). As what a set rejects holds what the set
before rejects, testing ends at the first failure and the sets of a stratum need no correction of their own. Of the
certified sets the one that tells good from bad fit rows best is used, the mildest of equals.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, stored, table

#: The symbols that are counted, and the base rules' limits.
SYMBOLS = b"#*$%&|<>"
FEWEST_WORDS = 50
MOST_REPEATED = 50

WHITE = b" \t\n\x0b\x0c\r"
#: A stratum's share of good texts that the rules may reject, and the chance that any stratum's bound is wrong.
RISK, CHANCE = 0.05, 0.05
#: Shares (in thousandths) of the good fit rows that a rule may pass at the steps of its path.
STEPS = (0, 1, 2, 5, 10, 20, 30, 50)
#: A rule is used in a stratum if at some step its share of bad fit rows is so much above that of good ones.
GAIN = 0.02
#: Statistics are integers up to this, so that a rule's values in a stratum are a bounded number of groups.
TOP = 20_000
NO_LANG = "und"
#: Beyond the last place in the order of tests.
END = 1000
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _repeated_words(words: list[bytes]) -> int:
    """Words in windows of three words that occur twice or more in the text, the first included."""
    if len(words) < 4:
        return 0
    ids: dict[bytes, int] = {}
    codes = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    pairs = np.unique(codes[:-2] * len(ids) + codes[1:-1], return_inverse=True)[1]
    _, windows, counts = np.unique(pairs * len(ids) + codes[2:], return_inverse=True, return_counts=True)
    if len(counts) == len(windows):
        return 0
    twice = counts[windows] > 1
    hit = np.zeros(len(words), bool)
    for i in range(3):
        hit[i : len(words) - 2 + i] |= twice
    return int(hit.sum())


def _statistics_of(text: str) -> tuple[int, ...]:
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    return (
        len(words), len(text) - (len(data) - len(data.translate(None, WHITE))), len(data) - len(data.translate(None, SYMBOLS)),
        len(lines), len(lines) - len(set(lines)), _repeated_words(words),
    )


def with_statistics(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """documents with the columns of STATISTICS and base_failed added or replaced.

    n_words, word_chars (code points in words), n_symbols, n_lines (lines with a word), n_dup_lines (those equal to
    an earlier one) and n_repeat_words are counted over the whole text, however long; a null or empty text has
    zeros and fails. Rows are judged one by one, so repeated rows stay repeated; an empty table stays empty.
    """

    @F.pandas_udf(", ".join(f"{c} long" for c in STATISTICS))
    def statistics(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([_statistics_of(t) for t in batch], columns=STATISTICS, dtype="int64")

    held = fresh(documents, "_statistics")
    out = documents.withColumn(held, statistics(F.coalesce(F.col(text_col), F.lit(""))))
    out = out.withColumns({c: F.col(f"{held}.{c}") for c in STATISTICS}).drop(held)
    return out.withColumn("base_failed", (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


def rules() -> dict[str, Column]:
    """The rules: integer statistics of which greater is worse; null where a text has no words."""
    share = lambda part, whole, by: F.expr(f"CAST(least({part} * {by} DIV nullif({whole}, 0), {TOP}) AS INT)")
    return {
        "symbols": share("n_symbols", "n_words", 1000), "long_words": share("word_chars", "n_words", 100), "short_words": -share("word_chars", "n_words", 100),
        "dup_lines": share("n_dup_lines", "n_lines", 1000), "repeats": share("n_repeat_words", "n_words", 1000),
    }


def is_fit(doc_id: Column) -> Column:
    """A quarter of the ids: they shape the cutoffs. All other labelled rows are held out."""
    return F.substring(F.md5(doc_id.cast("string")), 1, 1).isin("0", "1", "2", "3")


def tail(n: int, k: int, p: float) -> float:
    """P(X <= k) for X binomial of n and p: the regularised incomplete beta function, by a continued fraction."""
    if k >= n:
        return 1.0
    a, b, x = n - k, k + 1, 1 - p
    flip = x > (a + 1) / (a + b + 2)
    if flip:
        a, b, x = b, a, p
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 100_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d, c = 1 / (1 + even * d), 1 + even / c
        h *= d * c
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d, c = 1 / (1 + odd * d), 1 + odd / c
        h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return 1 - front * h if flip else front * h


def cutoffs(statistics: DataFrame, labels: DataFrame, id_col: str = "doc_id", stratum: Column | None = None, risk: float = RISK, chance: float = CHANCE) -> DataFrame:
    """One row per stratum that has a certified set of cutoffs: stratum, a cutoff for each rule (null: not used), its place
    in the order of tests and what certifies it (n_held_out good rows, n_rejected of them, the exact p_value, n_strata).

    statistics: with_statistics() of all rows; labels: id and quality (1: good), of which every row that passes the base
    rules counts. Ids whose labels differ count as bad; null ids and labels are left out. Labelled rows of repeated ids count
    each. A stratum with too few labels for a certificate gets no row: none of its texts are rejected. What is counted
    is grouped by integer statistics before it meets in a task, so a stratum may hold any share of the rows.
    """
    stratum = F.coalesce(F.col("lang"), F.lit(NO_LANG)) if stratum is None else stratum
    good = labels.where("quality IS NOT NULL").groupBy(F.col(id_col).alias("_id")).agg((F.min("quality") == 1).alias("good"))
    rows = statistics.where("NOT base_failed").select(F.col(id_col).alias("_id"), stratum.alias("stratum"), *(v.alias(k) for k, v in rules().items()))
    rows = stored(rows.join(good, "_id").select("*", is_fit(F.col("_id")).alias("fit")).drop("_id"))

    values = rows.where("fit").select("stratum", "good", F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), F.col(k).alias("value")) for k in rules()))).alias("_r"))
    counted = values.where("_r.value IS NOT NULL").groupBy("stratum", F.col("_r.rule").alias("rule"), F.col("_r.value").alias("value")).agg(F.sum(F.col("good").cast("long")).alias("g"), F.sum((~F.col("good")).cast("long")).alias("b"))
    each = Window.partitionBy("stratum", "rule")
    above = each.orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, -1)
    path = counted.select(
        "stratum", "rule", "value", F.coalesce(F.sum("g").over(above), F.lit(0)).alias("g"), F.coalesce(F.sum("b").over(above), F.lit(0)).alias("b"), F.sum("g").over(each).alias("all_g"), F.sum("b").over(each).alias("all_b")
    ).select("*", F.explode(F.array(*(F.lit(s) for s in STEPS))).alias("step"))
    path = path.where("1000 * g <= step * all_g AND all_g > 0 AND all_b > 0").groupBy("stratum", "rule", "step").agg(F.min_by(F.struct("value", (F.col("b") / F.col("all_b") - F.col("g") / F.col("all_g")).alias("gain")), "value").alias("at"))
    path = path.groupBy("stratum", "rule").agg(F.transform(F.sort_array(F.collect_list(F.struct("step", "at.value"))), lambda x: x["value"]).alias("cutoffs"), F.max("at.gain").alias("gain")).where(F.col("gain") >= GAIN)
    path = path.withColumn("turn", F.row_number().over(Window.partitionBy("stratum").orderBy(F.desc("gain"), "rule")) - 1)
    # a column for each rule: its cutoffs, one for each step, and its turn within a step
    path = stored(path.groupBy("stratum").pivot("rule", list(rules())).agg(F.first(F.struct("cutoffs", "turn"))))

    # each labelled row's place: the first in the order of tests at which it is rejected
    place = F.least(*(_place(F.col(k), F.col(f"path.{k}")) for k in rules()))
    tally = rows.join(path.select("stratum", F.struct(*rules()).alias("path")), "stratum").select("stratum", "fit", "good", F.coalesce(place, F.lit(END)).alias("place"))
    counts = {"fit_good": F.col("fit") & F.col("good"), "fit_bad": F.col("fit") & ~F.col("good"), "held_good": ~F.col("fit") & F.col("good")}
    tally = tally.groupBy("stratum", "place").agg(*(F.sum(v.cast("long")).alias(k) for k, v in counts.items()))
    # at most END places in a stratum
    upto, whole = Window.partitionBy("stratum").orderBy("place"), Window.partitionBy("stratum")
    tested = tally.select("stratum", "place", *(F.sum(c).over(upto).alias(c) for c in counts), *(F.sum(c).over(whole).alias(f"all_{c}") for c in counts)).where("all_held_good > 0")
    n_strata = F.broadcast(tested.agg(F.count_distinct("stratum").alias("n_strata")))  # one row
    tested = tested.where(F.col("place") < END).crossJoin(n_strata).select(
        "stratum", "place", F.col("all_held_good").alias("n_held_out"), F.col("held_good").alias("n_rejected"), "n_strata",
        (F.col("fit_bad") * F.col("all_fit_good") - F.col("fit_good") * F.col("all_fit_bad")).alias("worth"), _tails(risk)("all_held_good", "held_good").alias("p_value"),
    )
    certified = tested.where((F.col("p_value") * F.col("n_strata") <= chance) & (F.col("worth") > 0))
    chosen = certified.groupBy("stratum").agg(F.max_by(F.struct("place", "n_held_out", "n_rejected", "p_value", "n_strata"), F.struct("worth", -F.col("place"))).alias("_c")).select("stratum", "_c.*")
    at = {k: F.when(F.col("place") >= F.col(f"path.{k}.turn"), F.get(F.col(f"path.{k}.cutoffs"), F.floor((F.col("place") - F.col(f"path.{k}.turn")) / len(rules())).cast("int"))) for k in rules()}
    return chosen.join(path.select("stratum", F.struct(*rules()).alias("path")), "stratum").select("*", *(v.alias(k) for k, v in at.items())).drop("path")


def _place(value: Column, path: Column) -> Column:
    """The first place at which the rule of a path rejects a value, null if none."""
    passed = F.size(F.filter(path["cutoffs"], lambda c: value <= c))
    return F.when(passed < len(STEPS), passed * len(rules()) + path["turn"])


def _tails(risk: float):
    @F.pandas_udf("double")
    def tails(n: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([tail(int(a), int(b), risk) for a, b in zip(n, k, strict=True)], dtype="float64")

    return tails


def _rejects(value, cutoff) -> Column:
    out = F.lit(False)
    for k in rules():
        out = out | F.coalesce(value(k) > cutoff(k), F.lit(False))
    return out


def judged(statistics: DataFrame, found: DataFrame, stratum: Column | None = None) -> DataFrame:
    """statistics with `kept` added or replaced: neither base_failed nor rejected by the cutoffs of its stratum.

    found: the rows of cutoffs(). A stratum without a row keeps all that pass the base rules. One row per stratum
    is joined, so Spark broadcasts it if it is small and else splits the strata that are hot.
    """
    stratum = F.coalesce(F.col("lang"), F.lit(NO_LANG)) if stratum is None else stratum
    key, held = fresh(statistics, "_stratum"), fresh(statistics, "_cutoffs")
    found = found.select(F.col("stratum").alias(key), F.struct(*rules()).alias(held))
    out = statistics.withColumn(key, stratum).join(found, key, "left")
    for k, v in rules().items():
        out = out.withColumn(f"{held}_{k}", v)
    rejected = _rejects(lambda k: F.col(f"{held}_{k}"), lambda k: F.col(f"{held}.{k}"))
    return out.withColumn("kept", ~F.col("base_failed") & ~rejected).drop(key, held, *(f"{held}_{k}" for k in rules()))


def op13_quality(spark, sf_dir):
    """Statistics of all documents, read once and kept without the texts; cutoffs from all labels; the verdicts."""
    read = stored(with_statistics(table(spark, sf_dir, "documents").select("doc_id", "lang", "text")).drop("text"))
    found = stored(cutoffs(read, table(spark, sf_dir, "labels").select("doc_id", "quality")))
    return judged(read, found).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
