"""Toxicity by class-conditional Kneser-Ney models (operator 1).

Two models of the characters of words, one of toxic and one of ordinary texts, are fitted on a bounded
sample of labelled rows. Contexts are counted for each class, discounted, and interpolated with shorter
ones; the last, without a context, is shared by both classes, so that expressions rare in both weigh
about alike. A text's two log-likelihoods are compared by their difference over its number of words: over
all its words, and over the shares PEAKS of them that speak most for the toxic model, since a few words in a
long text make it toxic. These are put on a scale from 0 to 1 by a logistic fit on rows that the models had
not seen.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LETTER_WORD, stored, table
from .hashing import BASE, mixed

#: Characters of an n-gram at most.
ORDER = 6
#: Characters of the longest n-gram whose counts both classes share.
SHARED = 1
#: Shares of a text's words, those of the highest log-ratio, whose mean is a feature beside that of all words.
PEAKS = (0.02, 0.1)
#: Labelled rows of each class that models are fitted on at most: the bound of the sample.
MAX_ROWS = 1500
#: Parts of the sample: the rows of each are scored by a model of the others, and the scale is fitted on those scores.
FOLDS = 5
#: Words whose scores a Python worker remembers.
MEMORY = 400_000

find_words = re.compile(LETTER_WORD).findall


def words_of(text: str | None) -> list[str]:
    return find_words(text.lower()) if text else []


def _characters(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all characters of all words, with a start and an end mark: hash, place in the word, number of the word."""
    codes = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le"), np.uint32)
    first = np.flatnonzero(codes == 2).astype(np.int32)
    lengths = np.diff(np.append(first, len(codes)))
    offset = np.arange(len(codes), dtype=np.int32) - np.repeat(first, lengths)
    return mixed(codes.astype(np.uint64) + np.uint64(1)), offset, np.repeat(np.arange(len(words), dtype=np.int32), lengths)


def _longer(hashes: np.ndarray | None, values: np.ndarray) -> np.ndarray:
    """Hashes of the n-grams that end at each character from those one shorter: an n-gram's hash is built from its
    first n - 1 characters' and its last character."""
    return values if hashes is None else mixed(_previous(hashes) * np.uint64(BASE) + values)


def _previous(x: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, x.dtype), x[:-1]])


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return at, (keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool))


class KneserNey:
    """Log-ratio of two class models, by n-gram, as tables that are looked up from the longest n-gram down."""

    def __init__(self, words: list[str], toxic: np.ndarray, ordinary: np.ndarray):
        self.ratios: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.backoffs: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        if not words:
            return
        values, offset, word = _characters(words)
        weights = (np.asarray(toxic, float), np.asarray(ordinary, float))
        levels, hashes = [], None
        for n in range(1, ORDER + 1):
            shorter, hashes = hashes, _longer(hashes, values)
            at = np.flatnonzero((offset >= n - 1) & (offset >= 1))
            keys, first, inverse = np.unique(hashes[at], return_index=True, return_inverse=True)
            raw = [np.bincount(inverse, w[word[at]], len(keys)) for w in weights]
            where = at[first]
            shorter = np.zeros(len(values), np.uint64) if shorter is None else shorter
            levels.append({"keys": keys, "raw": raw, "context": shorter[where - 1] if n > 1 else shorter[where], "suffix": shorter[where], "anchored": offset[where] == n - 1})
            del at, first, inverse
        for n, level in enumerate(levels, 1):
            counts = level["raw"]
            if n < ORDER:
                # below the longest order an n-gram counts once for each character seen before it
                at, _ = _find(level["keys"], levels[n]["suffix"])
                kinds = [np.bincount(at, c > 0, len(level["keys"])) for c in levels[n]["raw"]]
                counts = [np.where(level["anchored"], r, k) for r, k in zip(counts, kinds, strict=True)]
            level["counts"] = [sum(counts)] * 2 if n <= SHARED else counts
        lower: list[np.ndarray] | None = None
        for n, level in enumerate(levels, 1):
            pooled = np.round(sum(level["counts"]) / (2 if n <= SHARED else 1))
            ones, twos = (pooled == 1).sum(), (pooled == 2).sum()
            discount = min(0.95, max(0.1, ones / max(1, ones + 2 * twos)))
            contexts, inverse = np.unique(level["context"], return_inverse=True)
            found, weight = [], []
            for c in (0, 1):
                count = level["counts"][c]
                total, kinds = np.bincount(inverse, count), np.bincount(inverse, count > 0)
                rest = np.where(total > 0, discount * kinds / np.maximum(total, 1e-9), 1.0)
                weight.append(rest)
                below = lower[c][_find(levels[n - 2]["keys"], level["suffix"])[0]] if lower else np.full(len(count), 1 / len(level["keys"]))
                own = np.maximum(count - discount, 0) / np.maximum(total, 1e-9)[inverse]
                found.append(np.where(total[inverse] > 0, own, 0) + rest[inverse] * below)
            lower = found
            if n > SHARED:
                self.ratios[n] = (level["keys"], np.log(found[0] / found[1]).astype(np.float32))
                self.backoffs[n] = (contexts, np.log(weight[0] / weight[1]).astype(np.float32))

    def of_words(self, words: list[str]) -> np.ndarray:
        """Toxic minus ordinary log-likelihood of each word."""
        if not words or not self.ratios:
            return np.zeros(len(words))
        values, offset, word = _characters(words)
        hashes = [np.zeros(len(values), np.uint64), values]
        for _ in range(2, ORDER + 1):
            hashes.append(_longer(hashes[-1], values))
        total = np.zeros(len(offset))
        left = np.flatnonzero(offset >= 1)
        for n in range(ORDER, SHARED, -1):
            long = offset[left] >= n - 1
            at, short = left[long], left[~long]
            keys, ratios = self.ratios[n]
            where, known = _find(keys, hashes[n][at])
            total[at[known]] += ratios[where[known]]
            at = at[~known]
            contexts, backoffs = self.backoffs[n]
            where, known = _find(contexts, hashes[n - 1][at - 1])
            total[at[known]] += backoffs[where[known]]
            left = np.concatenate([at, short])
        return np.bincount(word, total, len(words))


class Remembered(dict):
    def __init__(self, model: KneserNey):
        self.model = model

    def of_texts(self, texts: list[list[str]]) -> np.ndarray:
        """For each text the mean over its words, and over each share of PEAKS, one word at least; 0 for a text without words."""
        new = list({w for words in texts for w in words if w not in self})
        if len(self) + len(new) > MEMORY:
            self.clear()
            new = list({w for words in texts for w in words})
        self.update(zip(new, self.model.of_words(new).tolist(), strict=True))
        out = np.zeros((len(texts), 1 + len(PEAKS)))
        for i, words in enumerate(texts):
            if words:
                values = -np.sort(-np.fromiter(map(self.__getitem__, words), float, len(words)))
                out[i] = [values.mean(), *(values[: max(1, math.ceil(len(words) * share))].mean() for share in PEAKS)]
        return out


_remembered: dict[str, Remembered] = {}


def _slices(texts: list, size: int = 200) -> Iterator[list]:
    for i in range(0, len(texts), size):
        yield texts[i : i + size]


def _sample(labels: DataFrame, id_col: str, label_col: str, max_rows: int) -> tuple[DataFrame, list[int]]:
    """(doc_id, toxic, fold) of at most max_rows rows of each class, those of the least hashes, and both classes' sizes."""
    key = F.col(id_col).cast("string")
    rows = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (F.pmod(F.crc32(key.cast("binary")), F.lit(5)) != 0))
    rows = rows.groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic")).withColumn("h", F.xxhash64("_id", F.lit("fit")))
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    picked = [rows.filter(F.col("toxic") == c).orderBy("h", "_id").limit(max_rows) for c in (1, 0)]
    return picked[0].union(picked[1]).select("_id", "toxic", F.pmod("h", F.lit(FOLDS)).alias("fold")), [sizes.get(1, 0), sizes.get(0, 0)]


def _word_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        counts: Counter = Counter()
        for text, toxic, fold in zip(batch["text"], batch["toxic"], batch["fold"], strict=True):
            for w, n in Counter(words_of(text)).items():
                counts[w, toxic, fold] += n
        yield pd.DataFrame([(*key, n) for key, n in counts.items()], columns=["w", "toxic", "fold", "n"])


def _model(counts: pd.DataFrame) -> pd.DataFrame:
    counts = counts.sort_values("w", ignore_index=True)
    model = KneserNey(counts["w"].tolist(), counts["toxic"].to_numpy(), counts["ordinary"].to_numpy())
    return pd.DataFrame({"id": counts["id"].iloc[:1], "model": [pickle.dumps(model)]})


def _held_out(texts: pd.DataFrame, models: pd.DataFrame) -> pd.DataFrame:
    """Features of one part of the sample by the model of the others; 0 where these have no words."""
    memory = Remembered(pickle.loads(models["model"].iloc[0]) if len(models) else KneserNey([], np.zeros(0), np.zeros(0)))
    values = [memory.of_texts([words_of(t)])[0].tolist() for t in texts["text"]]
    return pd.DataFrame({"toxic": texts["toxic"], "values": pd.Series(values, index=texts.index, dtype=object)})


class Detector:
    """Models and logistic scale; holds no more than the sample's n-grams."""

    def __init__(self, model: KneserNey, intercept: float, slopes: np.ndarray):
        self.model, self.intercept, self.slopes = model, intercept, slopes
        self.name = repr((intercept, list(slopes)))

    def score(self, values: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.intercept + values @ self.slopes, -50, 50)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """Weighted logistic fit of y on the columns of x by Newton steps, with a little weight against steep slopes."""
    centre, scale = x.mean(0), x.std(0) + 1e-9
    z = np.concatenate([np.ones((len(x), 1)), (x - centre) / scale], 1)
    b = np.zeros(z.shape[1])
    for _ in range(80):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        slope = z.T @ (weight * (y - p)) - 1e-2 * b
        curve = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(len(b))
        step = np.linalg.solve(curve, slope)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return float(b[0] - (b[1:] * centre / scale).sum()), b[1:] / scale


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS) -> Detector:
    """Fit on labelled rows whose crc32(doc_id as text) mod 5 is not 0, max_rows of each class at most.

    Null labels and null ids are left out; a document labelled twice is toxic if either label says so. Each of
    several rows of one id is learned from. Rows of the least hash are taken, of equal hashes the least ids. With
    one class missing every text scores that of the known class; with no labels at all, or none of a document, 0.
    """
    picked, sizes = _sample(labels, id_col, label_col, max_rows)
    if not all(sizes):
        return Detector(KneserNey([], np.zeros(0), np.zeros(0)), 10.0 if sizes[0] else -50.0, np.zeros(1 + len(PEAKS)))
    rows = documents.select(F.col(id_col).alias("_doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = rows.join(F.broadcast(picked), F.col("_doc") == F.col("_id")).select("text", "toxic", "fold")
    counts = texts.mapInPandas(_word_counts, "w string, toxic int, fold long, n long").groupBy("w").agg(*[F.sum(F.when((F.col("toxic") == c) & (F.col("fold") == f), F.col("n")).otherwise(0)).alias(f"n{c}{f}") for c in (1, 0) for f in range(FOLDS)])
    # the models are made in tasks, one without each part and one of all; the parts are scored where their models are, and
    # only the last model and the sample's features reach the driver
    without = lambda c, left_out: sum(F.col(f"n{c}{f}") for f in range(FOLDS) if f != left_out)
    each = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("id"), without(1, i).alias("toxic"), without(0, i).alias("ordinary")) for i in range(FOLDS + 1)]))
    rows = counts.select("w", each.alias("x")).select("w", "x.*").filter("toxic + ordinary > 0")
    made = stored(rows.groupBy("id").applyInPandas(_model, "id long, model binary"))
    last = made.filter(F.col("id") == FOLDS).select("model").head()
    if last is None:
        return Detector(KneserNey([], np.zeros(0), np.zeros(0)), -50.0, np.zeros(1 + len(PEAKS)))
    model = pickle.loads(last.model)
    parts = made.filter(F.col("id") < FOLDS).withColumnRenamed("id", "fold").groupBy("fold")
    seen = texts.groupBy("fold").cogroup(parts).applyInPandas(_held_out, "toxic int, values array<double>").toPandas()
    y, x = seen["toxic"].to_numpy(float), np.array(seen["values"].tolist(), float).reshape(len(seen), -1)
    kept = [max(1, (y == c).sum()) for c in (1, 0)]
    weight = np.where(y == 1, sizes[0] / kept[0], sizes[1] / kept[1])
    return Detector(model, *_logistic(x, y, weight / weight.mean()))


def score(documents: DataFrame, detector: Detector, text_col: str = "text", column: str = "toxicity") -> DataFrame:
    """All columns of documents with `column` (0 to 1) added, or replaced if there.

    Null, empty and wordless texts get the score of log-ratios of 0. Every text is read whole. Equal texts score
    alike, repeated rows stay repeated, and an empty table gives an empty result.
    """
    shared = documents.sparkSession.sparkContext.broadcast(detector)

    @F.pandas_udf("double")
    def toxicity(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        found = shared.value
        if found.name not in _remembered:
            _remembered.clear()
            _remembered[found.name] = Remembered(found.model)
        memory = _remembered[found.name]
        for batch in batches:
            values = [memory.of_texts([words_of(t) for t in part]) for part in _slices(batch.tolist())]
            yield pd.Series(found.score(np.concatenate(values)) if values else [], dtype="float64")

    return documents.withColumn(column, toxicity(F.coalesce(F.col(text_col), F.lit(""))))


def op1_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    detector = fit(docs, table(spark, sf_dir, "labels"))
    key = F.col("doc_id").cast("string").cast("binary")
    held_out = F.coalesce(F.pmod(F.crc32(key), F.lit(5)) == 0, F.lit(False))
    return score(docs, detector).select("doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
