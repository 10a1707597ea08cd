"""Collocations of a corpus (operator 12), counted by multikey three-way quicksort of suffix pointers.

Words are counted first; a phrase's words are all at least as frequent as the phrase, so texts are cut at rarer words
(a filter of fixed size says which; what it lets through by mistake is only more work). From each word of what is left
starts a suffix of at most five words. Suffixes are routed by their two leading words, so that equal beginnings meet
in one task. There pointers to them are split three ways at one word after another: the part equal to the pivot in the
words so far is a phrase, its weight the count, and parts lighter than the least count are abandoned.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, stored, table

#: What ends a piece of text, and the words' letters that are lower-cased.
ENDS = b".,;:!?\n\x0b\x0c\r"
PREPARED = bytes.maketrans(UPPER.encode() + ENDS, LOWER.encode() + b"\n" * len(ENDS))
NO_LANG = "und"

DEPTH = 5
LEAST = 100
TOP = 2000
#: A phrase goes if a longer one holds it and has so many hundredths of its count.
COVER = 100
#: Distinct keys that a task counts before it hands them on, and suffixes that it sorts at once.
HELD, BLOCK = 400_000, 1_000_000
#: Bits of the filter of words: 2 ** 22, half a megabyte whatever the vocabulary.
BITS = 22
#: One piece in so many is looked at for phrases that begin too many suffixes for one task.
EVERY = 16
#: Such phrases are a share of 1 / MOST of all words at least, so that there are four times MOST at most.
MOST = 20_000
#: Suffixes that a task should get.
ROWS = 500_000


#: Stands between pieces and for words that are left out: a byte that no text has.
BREAK = b" \xff "


def _pieces(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(PREPARED).split(b"\n")


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(lang, phrase, size, n): words with their counts; '' with all words; sampled phrases that are a large share here."""
    counts: dict[str, Counter] = {}
    sampled: dict[str, Counter] = {}
    seen = taken = 0

    def out(found: dict[str, Counter], least: int, words: bool) -> pd.DataFrame:
        rows = [(lang, k.decode("utf-8", "surrogatepass"), 1 if words else k.count(b" ") + 1, n) for lang, c in found.items() for k, n in c.items() if n >= least]
        if words:
            rows += [(lang, "", 1, c.total()) for lang, c in found.items()]
        return pd.DataFrame(rows, columns=["lang", "phrase", "size", "n"])

    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            if lang not in counts:
                counts[lang], sampled[lang] = Counter(), Counter()
            pieces, some = _pieces(text), sampled[lang]
            counts[lang].update(b"\n".join(pieces).split())
            for piece in pieces[-seen % EVERY :: EVERY]:
                ws = piece.split()
                taken += len(ws)
                for size in range(2, DEPTH + 1):
                    some.update([b" ".join(ws[i : i + size]) for i in range(len(ws) - size + 1)])
            seen += len(pieces)
            if sum(map(len, sampled.values())) > HELD:
                sampled = {k: Counter({p: n for p, n in v.items() if n > 1 + taken // HELD}) for k, v in sampled.items()}
            if sum(map(len, counts.values())) > HELD:
                yield out(counts, 1, True)
                counts = {k: Counter() for k in counts}
    yield out(counts, 1, True)
    yield out(sampled, max(8, taken // (4 * MOST)), False)


def _bit(lang: str, word: bytes, bits: int = BITS) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode() + b"\0" + word) >> (64 - bits)


class _Filter(dict):
    """Whether a word may be frequent in a language, remembered."""

    def __init__(self, lang: str, bits: np.ndarray):
        self.lang, self.bits = lang, bits
        self[b"\xff"] = False

    def __missing__(self, word: bytes) -> bool:
        if len(self) >= HELD:
            self.clear()
            self[b"\xff"] = False
        at = _bit(self.lang, word)
        found = self[word] = bool(self.bits[at >> 3] >> (at & 7) & 1)
        return found


def _word_bits(words: DataFrame) -> np.ndarray:
    """The filter of the words of (lang, phrase): its set bytes only reach the driver, 2 ** (BITS - 3) at most."""

    def bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = np.array([_bit(lang, w.encode("utf-8", "surrogatepass")) for lang, w in zip(batch["lang"], batch["phrase"], strict=True)], np.int64)
            yield pd.DataFrame({"at": at >> 3, "bit": 1 << (at & 7)})

    found = words.mapInPandas(bits, "at long, bit long").groupBy("at").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(1 << (BITS - 3), np.uint8)
    out[found["at"].to_numpy(np.int64)] = found["bits"].to_numpy(np.uint8)
    return out


def _packed(lines: list[bytes]) -> tuple[bytes, int]:
    raw = b"\n".join(lines)
    return pa.compress(raw, codec="zstd", asbytes=True), len(raw)


def _suffixes(bits, hot, keys):
    """Per task rows of (key, lang, plain, plain_size, special, special_size): suffixes packed by the task that they are routed to.

    plain has a suffix in each line; special has suffix, number of leading words to route by, and weight, parted by tabs,
    where they are not 2 and 1. At depth 0 stands a count of a hot phrase.
    """
    schema = pa.schema([("key", pa.int64()), ("lang", pa.string()), ("plain", pa.binary()), ("plain_size", pa.int64()), ("special", pa.binary()), ("special_size", pa.int64())])

    def packed(counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        to = keys.value
        for lang, c in counts.items():
            beginnings, tongue = hot.value.get(lang, frozenset()), zlib.crc32(lang.encode("utf-8", "surrogatepass"))
            plain: list[list[bytes]] = [[] for _ in to]
            special: list[list[bytes]] = [[] for _ in to]
            heads: Counter = Counter()
            for suffix, n in c.items():
                depth, end = 2, suffix.find(b" ", suffix.find(b" ") + 1)
                while (head := suffix if end < 0 else suffix[:end]) in beginnings:
                    heads[head] += n
                    if end < 0:
                        break
                    depth, end = depth + 1, suffix.find(b" ", end + 1)
                else:
                    at = zlib.crc32(head, tongue) % len(to)
                    if depth == 2 and n == 1:
                        plain[at].append(suffix)
                    else:
                        special[at].append(b"%b\t%d\t%d" % (suffix, depth, n))
            for head, n in heads.items():
                special[zlib.crc32(head, tongue) % len(to)].append(b"%b\t0\t%d" % (head, n))
            rows = [(to[i], lang, *_packed(p), *_packed(s)) for i, (p, s) in enumerate(zip(plain, special, strict=True)) if p or s]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters: dict[str, _Filter] = {}
        counts: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if lang not in counts:
                    filters[lang], counts[lang] = _Filter(lang, bits.value), Counter()
                known, c = filters[lang], counts[lang]
                words = BREAK.join(_pieces(text)).split()
                runs = [run.split() for run in b" ".join([w if known[w] else b"\xff" for w in words]).split(b"\xff") if b" " in run[1:-1]]
                c.update([b" ".join(run[i : i + DEPTH]) for run in runs for i in range(len(run) - 1)])
                if len(c) > HELD // 4 and sum(map(len, counts.values())) > HELD:
                    yield from packed(counts)
                    counts = {k: Counter() for k in counts}
        yield from packed(counts)

    return emit


def three_way(codes: np.ndarray, weights: np.ndarray, depths: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, int]]:
    """Multikey three-way quicksort of pointers to rows of codes: (codes of a beginning, its weight) for beginnings of two words or more.

    codes: the language and up to DEPTH words by rows, 0 where a suffix has ended. Beginnings lighter than `least`, or shorter
    than the depth that their rows were routed by, are not reported; light parts are not split further.
    """
    todo = [(np.arange(len(codes)), 0)]
    while todo:
        at, depth = todo.pop()
        if weights[at].sum() < least:
            continue
        column = codes[at, depth]
        pivot = sorted((int(column[0]), int(column[len(at) // 2]), int(column[-1])))[1]
        equal = column == pivot
        if len(at) > (same := int(equal.sum())):
            less = column < pivot
            todo += [(part, depth) for part in (at[less], at[~(less | equal)]) if len(part)]
            at = at[equal] if same else at[:0]
        if not len(at) or not pivot:
            continue
        weight = int(weights[at].sum())
        if weight >= least:
            if depth > 1 and depth >= depths[at[0]]:
                yield codes[at[0], : depth + 1], weight
            if depth < DEPTH:
                todo.append((at, depth + 1))


_Block = list[tuple[str, bytes, bytes]]


def _sorted_block(block: _Block, least: int) -> pa.RecordBatch:
    """(lang, phrase, n) of the frequent beginnings of a block of suffixes: (lang, plain lines, special lines)."""
    langs, texts, depths, weights, counted = [], [], [], [], []
    for lang, plain, special in block:
        if plain:
            n = plain.count(b"\n") + 1
            texts.append(plain)
            langs.append((lang, n))
            depths.append(np.full(n, 2, np.int64))
            weights.append(np.ones(n, np.int64))
        if special:
            rows = [line.split(b"\t") for line in special.split(b"\n")]
            counted += [(lang, r[0].decode("utf-8", "surrogatepass"), int(r[2])) for r in rows if r[1] == b"0"]
            rows = [r for r in rows if r[1] != b"0"]
            if rows:
                texts.append(b"\n".join([r[0] for r in rows]))
                langs.append((lang, len(rows)))
                depths.append(np.array([int(r[1]) for r in rows], np.int64))
                weights.append(np.array([int(r[2]) for r in rows], np.int64))
    if texts:
        tongues = sorted({lang for lang, _ in langs})
        lists = pc.split_pattern(pc.split_pattern(pa.array([b"\n".join(texts).decode("utf-8", "surrogatepass")]), "\n").flatten(), " ")
        words, offsets = lists.flatten().dictionary_encode(), lists.offsets.to_numpy()
        sizes = np.diff(offsets)
        codes = np.zeros((len(sizes), DEPTH + 1), np.int32)
        codes[:, 0] = np.repeat([tongues.index(lang) + 1 for lang, _ in langs], [n for _, n in langs])
        rows = np.repeat(np.arange(len(sizes)), sizes)
        codes[rows, 1 + np.arange(len(rows)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = words.indices.to_numpy() + 1
        names = words.dictionary.to_pylist()
        counted += [(tongues[c[0] - 1], " ".join([names[x - 1] for x in c[1:]]), n) for c, n in three_way(codes, np.concatenate(weights), np.concatenate(depths), least)]
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in counted], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "phrase", "n"])


def _count_suffixes(least: int, most: int):
    """Sorts the suffixes of a task. If there are more than `most`, block by block, with parts of counts of all phrases."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: _Block = []
        rows, parts = 0, False
        for batch in batches:
            for lang, plain, n, special, m in zip(*(batch[c].to_pylist() for c in ("lang", "plain", "plain_size", "special", "special_size")), strict=True):
                one = (lang, *(pa.decompress(x, size, codec="zstd", asbytes=True) if size else b"" for x, size in ((plain, n), (special, m))))
                more = one[1].count(b"\n") + one[2].count(b"\n") + 2
                if held and rows + more > most:
                    parts = True
                    yield _sorted_block(held, 1)
                    held, rows = [], 0
                held.append(one)
                rows += more
        if held:
            yield _sorted_block(held, 1 if parts else least)

    return count


def _keys(spark: SparkSession, partitions: int) -> list[int]:
    """For each partition a number that repartition(partitions, ...) sends there, so that tasks get equal shares."""
    numbers = spark.range(20 * partitions + 1000).groupBy(F.expr(f"pmod(hash(id), {partitions})").alias("p")).agg(F.min("id").alias("id"))
    return [r.id for r in numbers.orderBy("p").collect()]  # one for each partition


def phrase_counts(documents: DataFrame, least: int = LEAST, block: int = BLOCK, hot_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(totals, counts): lang and n, all words; lang, phrase, size and n of the phrases of 1 to 5 words with n >= least. Both written.

    documents: lang (null: `und`) and text (null: empty). Phrases that begin a large share of the suffixes, found on a
    sample of pieces, are counted where the texts are read, and their suffixes routed by one word more, as often as needed;
    equal suffixes are one row for each task. This steers work only: counts are of all texts and exact. A task that still
    gets more than `block` suffixes sorts them in blocks and hands on parts of counts, which are summed after.
    """
    spark = documents.sparkSession
    texts = documents.select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    words = stored(texts.mapInPandas(_count_words, "lang string, phrase string, size int, n long").groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n")).where((F.col("phrase") == "") | (F.col("size") > 1) | (F.col("n") >= least)))
    totals = words.where("phrase = ''").select("lang", "n")
    frequent = words.where("phrase <> '' AND size = 1")
    total = totals.agg(F.sum("n")).first()[0] or 0
    share = max(hot_rows or ROWS // 4, total // MOST) // EVERY
    hot: dict[str, set[bytes]] = {}
    # at most 4 * MOST phrases, each at least 1 / MOST of the sample
    for lang, phrase in words.where((F.col("size") > 1) & (F.col("n") > share)).select("lang", "phrase").toLocalIterator():
        hot.setdefault(lang, set()).add(phrase.encode("utf-8", "surrogatepass"))
    send = spark.sparkContext.broadcast
    partitions = total // ROWS + int(spark.conf.get("spark.sql.shuffle.partitions"))
    suffixes = texts.mapInArrow(_suffixes(send(_word_bits(frequent)), send(hot), send(_keys(spark, partitions))), "key long, lang string, plain binary, plain_size long, special binary, special_size long")
    counted = suffixes.repartition(partitions, "key").mapInArrow(_count_suffixes(least, block), "lang string, phrase string, n long")
    longer = counted.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    counts = frequent.unionByName(longer.select("lang", "phrase", F.size(F.split("phrase", " ")).alias("size"), "n"))
    return totals, stored(counts)


def collocations(documents: DataFrame, least: int = LEAST, top: int = TOP, cover: int = COVER) -> DataFrame:
    """Per lang the `top` phrases of 2 to 5 words that stand together more often than their parts' counts would tell.

    lang, rank, phrase, a (its count), l and r (counts of the two parts at the cut that scores lowest, the earliest of
    equals), n (all words of lang) and score = floor(1000 * a * n / (l * r)), computed exactly. Phrases that a longer one
    holds with `cover` hundredths of their count or more are left out. Ordered by score, count, phrase. A corpus without
    frequent phrases, or an empty one, gives no rows; null texts are empty, null languages `und`.
    """
    totals, counts = phrase_counts(documents, least)
    phrases = counts.where("size > 1").select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("ws"))
    cuts = phrases.select("lang", "phrase", "a", "ws", F.explode(F.sequence(F.lit(1), F.size("ws") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("ws", F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice("ws", F.col("k") + 1, F.size("ws")), " ").alias("rest")
    )
    part = lambda key, value: counts.select("lang", F.col("phrase").alias(key), F.col("n").alias(value))
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).join(totals, "lang")
    whole = lambda c: F.col(c).cast("decimal(17,0)")
    cuts = cuts.select("*", (F.lit(1000).cast("decimal(4,0)") * whole("a") * whole("n")).alias("_over"), (whole("l") * whole("r")).alias("_under")).select("*", F.expr("_over DIV _under").alias("score"))
    scored = cuts.groupBy("lang", "phrase").agg(F.min_by(F.struct("a", "l", "r", "n", "score"), F.struct("score", "k")).alias("s")).select("lang", "phrase", "s.*")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size("ws") - 1), lambda size: F.transform(F.sequence(F.lit(1), F.size("ws") - size + 1), lambda i: F.array_join(F.slice("ws", i, size), " "))))
    covered = phrases.where(F.size("ws") > 2).select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = scored.join(covered, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < cover * F.col("a")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return left.withColumn("rank", rank.cast("int")).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


SQL = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
n AS (SELECT lang, sum(len(ws))::HUGEINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS k))),
f AS (SELECT lang, k AS size, phrase, count(*)::HUGEINT AS f FROM g GROUP BY lang, k, phrase HAVING count(*) >= 100),
c AS (SELECT lang, phrase, f AS a, size, string_split(phrase, ' ') AS ws FROM f WHERE size > 1),
k AS (SELECT lang, phrase, a, k, array_to_string(ws[1:k], ' ') AS first, array_to_string(ws[k + 1:size], ' ') AS rest FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
s AS (SELECT k.lang, k.phrase, a, x.f AS l, y.f AS r, n.n, (1000 * a * n.n) // (x.f * y.f) AS score, k FROM k JOIN f x ON k.lang = x.lang AND k.first = x.phrase JOIN f y ON k.lang = y.lang AND k.rest = y.phrase JOIN n ON n.lang = k.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(a) AS longer FROM (SELECT *, unnest(range(1, size - m + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS m FROM c)) GROUP BY ALL),
t AS (SELECT b.* FROM b LEFT JOIN o USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM t) WHERE rank <= 2000
"""
