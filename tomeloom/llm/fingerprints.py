"""Document fingerprints: bottom-k sketches of shingle hashes (operator 9). DataFrame functions only."""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import letter_words, shingle_hashes, table

#: Hashes kept of a text: the standard error of a likeness is at most 0.5 / sqrt(SKETCH) = 0.03.
SKETCH = 256
SHINGLE = 5
#: Bytes of text in a range of ids, ranges for each partition at least, and ranges at most (each a number on the driver).
RANGE_BYTES, RANGES_EACH, MAX_RANGES = 16 << 20, 8, 100_000


def bottom_k(hashes: Column, k: int = SKETCH) -> Column:
    """The k smallest distinct hashes, ascending: the sketch of a set."""
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch(text: Column, k: int = SKETCH, shingle: int = SHINGLE) -> Column:
    """Sketch of the shingles of a text's lower-cased words. Null and wordless texts have an empty one."""
    return F.element_at(F.transform(F.array(letter_words(text)), lambda words: bottom_k(shingle_hashes(words, shingle), k)), 1)


def merged(a: Column, b: Column, k: int = SKETCH) -> Column:
    """Sketch of the union of two sketched sets; parts of a text or corpus merge in any order."""
    return bottom_k(F.concat(a, b), k)


def resemblance(a: Column, b: Column, k: int = SKETCH) -> Column:
    """Estimated Jaccard likeness; exact below k shingles. Two empty sets are alike, an empty and another are not."""
    both = merged(a, b, k)
    shared = F.size(F.array_intersect(both, F.array_intersect(a, b)))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(shared / F.size(both))


def distinct_count(a: Column, k: int = SKETCH) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    top = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / top)


def containment(a: Column, b: Column, k: int = SKETCH) -> Column:
    """Estimated share of a's shingles that b has too, from resemblance and distinct counts, within 0 and 1."""
    r = resemblance(a, b, k)
    shared = r / (1 + r) * (distinct_count(a, k) + distinct_count(b, k))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / F.greatest(distinct_count(a, k), F.lit(1.0))))


def merge_sketches(df: DataFrame, keys: list[str], col: str, k: int = SKETCH) -> DataFrame:
    """One sketch for each group: hashes are made distinct before the groups meet, and k of a group stay."""
    hashes = df.select(*keys, F.explode(col).alias("_h")).distinct()
    rank = F.row_number().over(W.partitionBy(*keys).orderBy("_h"))
    return hashes.withColumn("_r", rank).filter(F.col("_r") <= k).groupBy(*keys).agg(F.sort_array(F.collect_list("_h")).alias(col))


def as_text(a: Column) -> Column:
    """Fixed-width hex of a sketch."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def _ranges(df: DataFrame, key: str, hash_col: str, size: Column) -> Column:
    """A column with the number of the range that a row falls in by (key, hash_col), nulls last.

    There are as many ranges as RANGE_BYTES go into the sizes, RANGES_EACH for each partition at least, so
    that partitions are even. Only bounds reach the driver, one for each range. An id that fills several
    ranges by itself, or no id, is split by hash. Looked up in two steps: a row costs twice the root of their number.
    """
    spark = df.sparkSession
    about = df.agg(F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.count("*").alias("n"), F.count_if(F.col(key).isNull()).alias("nulls")).first()
    n = int(min(MAX_RANGES, max(about.bytes // RANGE_BYTES, RANGES_EACH * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    found = df.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 10 * n)).first()[0] if n > 1 else None
    times = Counter(found or [])
    bounds = sorted(times)
    share = (F.col(hash_col) / F.lit(2.0**64)) + 0.5  # of the hashes below this one
    part = lambda m: F.least(F.floor(share * m), F.lit(m - 1) if isinstance(m, int) else m - 1).cast("long")
    inner = n + 1  # parts of an id at most, and one for the ids after it in its range
    nulls = F.lit((len(bounds) + 1) * inner) + part(max(1, -(-about.nulls * n // max(1, about.n))))
    if not bounds:
        return F.when(F.col(key).isNotNull(), F.lit(0).cast("long")).otherwise(nulls)
    step = max(1, math.isqrt(len(bounds)))
    ints = lambda xs: F.array(*[F.lit(x).cast("bigint") for x in xs]) if xs else F.array().cast("array<bigint>")
    at = F.size(F.filter(ints(bounds[step::step]), lambda b: b <= F.col(key)))
    number = at * step + F.size(F.filter(F.slice(ints(bounds), at * step + 1, step), lambda b: b <= F.col(key)))
    hot = {b: m for b, m in times.items() if m > 1}
    within = F.lit(0).cast("long")
    if hot:
        many = F.try_element_at(F.create_map(*[F.lit(x).cast("bigint") for pair in hot.items() for x in pair]), F.col(key))
        last = F.array_contains(ints(sorted(hot)), F.get(ints(bounds), number - 1))
        within = F.when(many.isNotNull(), part(many)).when(last, F.lit(inner - 1)).otherwise(0)
    return F.when(F.col(key).isNotNull(), number.cast("long") * inner + within).otherwise(nulls)


def with_next(df: DataFrame, key: str, cols: list[str], later: dict | None = None) -> DataFrame:
    """Add next_<c> for each c of cols: its value in the row that follows by key (nulls last, ties by the hash of
    cols, then by cols), after the last the first. `later` names columns made from cols after the rows have been
    dealt out, with next_<name> as well, so that they are neither shuffled nor made twice.

    Rows are dealt out by ranges, and one row for each range tells what the range before needs, so no task
    sees all rows, whatever repeats.
    """
    later = later or {}
    hashed = df.withColumn("_h", F.xxhash64(*cols))
    rows = hashed.withColumn("_range", _ranges(hashed, key, "_h", sum((F.coalesce(F.octet_length(F.col(c)), F.lit(0)) for c in cols), F.lit(0).cast("long"))))
    order = [F.col(key).asc_nulls_last(), F.col("_h"), *[F.col(c).asc_nulls_first() for c in cols]]
    w = W.partitionBy("_range").orderBy(*order)
    out = rows.withColumns({f"next_{c}": F.lead(c).over(w) for c in cols} | {"_last": F.lead(F.lit(False), 1, True).over(w)})
    out = out.withColumns(later)
    if later:
        out = out.withColumns({f"next_{c}": F.lead(c).over(w) for c in later})
    # the first row of each range: found by the least key and hash, then by the least of the cols, a row for each range
    # (nulls are replaced only for being told apart: a null key shares no range with others)
    spot = F.struct(F.coalesce(F.col(key), F.lit(0)), F.col("_h"))
    least = rows.groupBy("_range").agg(F.min(spot).alias("_least")).withColumnRenamed("_range", "_r")
    heads = rows.join(F.broadcast(least), (F.col("_range") == F.col("_r")) & (spot == F.col("_least")), "inner")
    heads = heads.select("_range", F.struct(*cols).alias("_head")).groupBy("_range").agg(F.min("_head").alias("_head"))
    heads = heads.select("_range", *[F.col(f"_head.{c}").alias(c) for c in cols]).withColumns(later)
    names = [*cols, *later]
    ring = W.orderBy("_range")
    whole = W.orderBy("_range").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    packed = F.struct(*names)
    heads = heads.select(F.col("_range").alias("_r"), F.coalesce(F.lead(packed).over(ring), F.first(packed).over(whole)).alias("_after"))
    out = out.join(heads, F.col("_range") == F.col("_r"), "left")
    picked = {f"next_{c}": F.when(F.col("_last"), F.col(f"_after.{c}")).otherwise(F.col(f"next_{c}")) for c in names}
    return out.withColumns(picked).drop("_range", "_r", "_after", "_last", "_h")


def edited(text: Column, following: Column) -> Column:
    """The last quarter of the code points (rounded down) replaced by the first as many, or all, of the following text."""
    n = F.char_length(text)
    m = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - m), F.substring(following, F.lit(1), m))


def fingerprint(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SKETCH) -> DataFrame:
    """Per document: its id, n_chars, sketches of its text, its edited text and the next document's text.

    Null texts count as empty; null ids come last; repeated ids are ordered by their texts' hashes, then by their texts. A lone
    document follows itself. An empty table gives an empty result; other columns are left out.
    """
    docs = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = with_next(docs, "doc_id", ["text"], {"sketch": sketch(F.col("text"), k)})
    rows = rows.withColumn("edited", edited(F.col("text"), F.col("next_text")))
    return rows.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), "edited", "sketch", "next_sketch", sketch(F.col("edited"), k).alias("edited_sketch"))


def op9_fingerprint(spark, sf_dir):
    rows = fingerprint(table(spark, sf_dir, "documents"))
    likeness = {"near_edited": resemblance(F.col("sketch"), F.col("edited_sketch")), "near_next": resemblance(F.col("sketch"), F.col("next_sketch"))}
    rows = rows.withColumns(likeness)
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"), "near_edited", "near_next")
