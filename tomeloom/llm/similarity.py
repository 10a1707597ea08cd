"""N-gram Jaccard join with Bayesian candidate pruning (operator 10).

1. Texts with the same set of word shingles are one kind, found by a hash of the set; only one text of
   a kind goes on.
2. MinHash bands name candidates: BANDS keys of ROWS values each miss a pair at the threshold with a
   chance below 1e-6. Buckets with the same members are compared once.
3. MinHash values of a bucket's members are compared STEP at a time; a pair goes as soon as the posterior
   chance that its Jaccard likeness reaches the threshold, given the matches so far and a uniform prior,
   is below TOLERANCE. What is left holds candidate groups together; a task returns the edges of a
   spanning forest, never all pairs.
4. The members of each candidate group are pruned alike and verified exactly on their shingle sets.
   A task returns the number of links of each member and a spanning forest of the links.

Buckets and groups are compared in blocks, each pair of blocks in a task of its own, so that none is one
task's work. Edges grow into groups by rounds of joins.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LETTER_WORD, LOWER, UPPER, lowered, stored, table
from .hashing import BASE, HASHER, mixed, signed

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 30, 4
HASHES = BANDS * ROWS
STEP = 8
TOLERANCE = 1e-9
#: Members of a block: a task compares BLOCK x BLOCK pairs at most at a time.
BLOCK = 512
#: Ids whose texts are read again that are broadcast at most; beyond it the join shuffles.
BROADCAST_IDS = 1_000_000

_rng = np.random.default_rng(20240229)
_MULTIPLIERS = _rng.integers(0, 1 << 64, HASHES, np.uint64) | np.uint64(1)
_SHIFTS = _rng.integers(0, 1 << 64, HASHES, np.uint64)

_find = re.compile(LETTER_WORD).findall


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of runs of `size` words; fewer words, but not none, are one shingle."""
    codes = HASHER.codes(_find(lowered(text))) if text else np.zeros(0, np.uint64)
    if not len(codes):
        return codes
    size = min(size, len(codes))
    count = len(codes) - size + 1
    value = codes[:count]
    for i in range(1, size):
        value = mixed(value) * np.uint64(BASE) + codes[i : i + count]
    return np.unique(mixed(value))


def minhash(shingles: np.ndarray) -> np.ndarray:
    """HASHES values of 32 bits."""
    least = np.full(HASHES, np.uint64(2**64 - 1))
    for i in range(0, len(shingles), 2048):
        part = shingles[None, i : i + 2048] * _MULTIPLIERS[:, None] + _SHIFTS[:, None]
        np.minimum(least, part.min(1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


@lru_cache(None)
def fewest_matches(threshold: float, tolerance: float) -> tuple[int, ...]:
    """For n = STEP, 2 STEP, ... compared values, the fewest matches that keep a pair.

    Under a uniform prior of the likeness the posterior is Beta(m + 1, n - m + 1), and its upper tail
    from t is the chance that a binomial of n + 1 trials of chance t has m successes or fewer.
    """
    found = []
    for n in range(STEP, HASHES + 1, STEP):
        tail, m = 0.0, -1
        while tail < tolerance:
            m += 1
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        found.append(m)
    return tuple(found)


def _signatures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """r, kind and sketch for the text of each row: r numbers all rows, whatever their ids. Other columns go along."""
    r = TaskContext.get().partitionId() << 36
    for batch in batches:
        kinds, sketches = [], []
        for text in batch["text"]:
            shingles = shingle_set(text)
            kinds.append(xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else b"")
            sketches.append(minhash(shingles).tobytes() if len(shingles) else b"")
        yield batch.drop(columns="text").assign(r=np.arange(r, r + len(batch)), kind=kinds, sketch=sketches)
        r += len(batch)


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sets = [shingle_set(t) for t in batch["text"]]
        kinds = [xxhash.xxh3_128_digest(x.tobytes()) for x in sets]
        yield pd.DataFrame({"kind": kinds, "shingles": [x.tobytes() for x in sets]})


def _band_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    bands = np.arange(BANDS, dtype=np.uint64)
    for batch in batches:
        if len(batch):
            values = np.frombuffer(b"".join(batch["sketch"]), np.uint32).astype(np.uint64).reshape(len(batch), BANDS, ROWS)
            key = np.broadcast_to(mixed(bands + np.uint64(1)), (len(batch), BANDS))
            for i in range(ROWS):
                key = mixed(key * np.uint64(BASE) + values[:, :, i])
            # the band's number leads
            key = (bands << np.uint64(58)) | (key >> np.uint64(6))
            yield pd.DataFrame({"key": signed(key.ravel()), "rep": np.repeat(batch["rep"].to_numpy(), BANDS)})


def _matches(a: np.ndarray, b: np.ndarray, threshold: float, tolerance: float) -> np.ndarray:
    """Index pairs of rows of a and b that Bayesian pruning keeps."""
    least = fewest_matches(threshold, tolerance)
    same = np.zeros((len(a), len(b)), np.uint8)
    for i in range(STEP):
        same += a[:, i, None] == b[None, :, i]
    at = np.argwhere(same >= least[0])
    same = same[at[:, 0], at[:, 1]]
    for k in range(1, len(least)):
        same = same + (a[at[:, 0], k * STEP : (k + 1) * STEP] == b[at[:, 1], k * STEP : (k + 1) * STEP]).sum(1)
        kept = same >= least[k]
        at, same = at[kept], same[kept]
    return at


def _verified(sets: list[np.ndarray], at: np.ndarray, threshold: float) -> np.ndarray:
    """The pairs whose exact Jaccard likeness reaches the threshold: shared shingles over all shingles."""
    kept = []
    for i, j in at.tolist():
        a, b = sets[i], sets[j]
        if min(len(a), len(b)) < threshold * max(len(a), len(b)) - 1e-9:
            continue
        if len(a) > len(b):
            a, b = b, a
        spot = np.searchsorted(b, a)
        shared = int((b[np.minimum(spot, len(b) - 1)] == a).sum())
        # in whole numbers, so that a likeness at the threshold is never rounded away
        if shared * 1000 >= round(threshold * 1000) * (len(a) + len(b) - shared):
            kept.append((i, j))
    return np.array(kept, np.int64).reshape(-1, 2)


def _forest(ids: np.ndarray, at: np.ndarray) -> list[tuple[int, int]]:
    """Edges (u, v), u < v, that hold together what the index pairs do."""
    parent = {x: x for x in ids.tolist()}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    edges = []
    for a, b in zip(ids[at[:, 0]].tolist(), ids[at[:, 1]].tolist(), strict=True):
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
            edges.append((min(a, b), max(a, b)))
    return edges


def _groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of rows of one (key, first, second), which follow each other; a run is two blocks at most."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        keys = batch[["key", "first", "second"]].to_numpy()
        ends = np.append(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, len(batch))
        start = 0
        if held and (held[-1][["key", "first", "second"]].to_numpy()[-1] != keys[0]).any():
            yield pd.concat(held) if len(held) > 1 else held[0]
            held = []
        for end in ends:
            held.append(batch.iloc[start:end])
            start = end
            if end < len(batch):
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def _pairs(group: pd.DataFrame, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the group's rows, and index pairs of its two blocks that pruning keeps."""
    sketches = np.frombuffer(b"".join(group["sketch"]), np.uint32).reshape(len(group), HASHES)
    block, first, second = group["block"].to_numpy(), group["first"].iat[0], group["second"].iat[0]
    left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
    at = _matches(sketches[left], sketches[right], threshold, tolerance)
    at = np.stack([left[at[:, 0]], right[at[:, 1]]], 1)
    return group["rep"].to_numpy(), at[at[:, 0] < at[:, 1]] if first == second else at


def _candidates(threshold: float, tolerance: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _groups(batches):
            ids, at = _pairs(group, threshold, tolerance)
            if len(at):
                yield pd.DataFrame(_forest(ids, at), columns=["u", "v"])

    return run


def _links(threshold: float, tolerance: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _groups(batches):
            ids, at = _pairs(group, threshold, tolerance)
            sets, copies = [np.frombuffer(x, np.uint64) for x in group["shingles"]], group["copies"].to_numpy()
            at = _verified(sets, at, threshold)
            if len(at):
                links = np.bincount(at[:, 0], copies[at[:, 1]], len(ids)) + np.bincount(at[:, 1], copies[at[:, 0]], len(ids))
                has = np.flatnonzero(links)
                edges = _forest(ids, at)
                rows = [(int(i), int(n), None) for i, n in zip(ids[has], links[has], strict=True)] + [(v, 0, u) for u, v in edges]
                yield pd.DataFrame({"rep": [r[0] for r in rows], "links": [r[1] for r in rows], "other": pd.array([r[2] for r in rows], "Int64")})

    return run


def connected(edges: DataFrame) -> DataFrame:
    """edges(u, v), u < v -> (node, root): the least node of each connected group, for all nodes of edges.

    Rounds of large-star and small-star: each node's neighbours are hung on its least one. A round is
    two shuffles whose sums shrink first where they are read; rounds end when nothing changes, about
    the logarithm of the longest path. Each round is a written table, and so are the least neighbours,
    a row for each node: a hub's edges meet its row in a join that is split where they are many.
    """
    edges = stored(edges.distinct())
    before = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m")))
        large = both.filter("v > u").join(least, F.col("u") == F.col("n")).select("v", "m").filter("v <> m").select(F.col("m").alias("u"), "v").distinct()
        down = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(down.withColumnRenamed("v", "x"), F.col("v") == F.col("x"))
        small = small.select(F.col("m").alias("u"), F.col("v")).union(small.filter("u <> m").select(F.least("m", "u"), F.greatest("m", "u"))).distinct()
        edges = stored(small)
        now = edges.agg(F.count("*"), F.sum("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node"), F.col("u").alias("root"))
    return roots.union(edges.select("u", "u")).distinct()


def _placed(members: DataFrame, block: int) -> DataFrame:
    """members(key, rep, members) -> one row for each pair of blocks that the member is compared in."""
    blocks = F.ceil(F.col("members") / block).cast("int")
    rows = members.select("key", "rep", blocks.alias("blocks")).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    rows = rows.select("key", "rep", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return rows.select("key", "rep", "block", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"))


def _dealt(placed: DataFrame) -> DataFrame:
    keys = ["key", "first", "second"]
    return placed.repartition(*keys).sortWithinPartitions(*keys)


def similar(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    """Per document row: doc_id, class_id, copy_id, n_links.

    copy_id is the least id with the same shingle set, class_id the least id of the group that links
    hold together, n_links the number of other rows whose likeness reaches the threshold, copies
    included. Rows are told apart by their number, not their id: rows of one id are judged each by its own
    text, and a null id links like any other; the least id is null only where all are. Texts without words
    (null too) link to nothing and are classes of their own. An empty table gives an empty result.
    """
    return similar_rows(documents, id_col, text_col, threshold, tolerance, block).select("doc_id", "class_id", "copy_id", "n_links")


def similar_rows(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK, carry: list[str] = ()) -> DataFrame:
    """As similar(), with class_row, a number of the class (null for texts without words), and the columns of `carry`."""
    rows = documents.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("text"), F.struct(F.lit(0).alias("none"), *carry).alias("carried"))
    signed_ = stored(rows.mapInPandas(_signatures, f"d long, carried {rows.schema['carried'].dataType.simpleString()}, r long, kind binary, sketch binary"))
    # one row stands for each kind; its number, written once, names the kind from here on
    first = F.min(F.struct(F.col("d").isNull().alias("none"), "d", "r")).alias("x")
    kinds = stored(signed_.filter(F.octet_length("kind") > 0).groupBy("kind").agg(first, F.count("*").alias("copies")).select("kind", F.col("x.r").alias("rep"), F.col("x.d").alias("least"), "copies"))
    reps = stored(signed_.select("r", "sketch").join(kinds.select("rep", "copies"), F.col("r") == F.col("rep")).select("rep", "sketch", "copies"))

    keys = stored(reps.mapInPandas(_band_keys, "key long, rep long"))
    buckets = keys.groupBy("key").agg(F.count("*").alias("members"), F.bit_xor(F.xxhash64("rep")).alias("who")).filter("members > 1")
    buckets = buckets.groupBy("members", "who").agg(F.min("key").alias("k"))
    members = keys.join(buckets, F.col("key") == F.col("k")).select("key", "rep", "members")
    near = _dealt(_placed(members, block).join(reps.select("rep", "sketch"), "rep"))
    candidates = stored(near.select("key", "first", "second", "block", "rep", "sketch").mapInPandas(_candidates(threshold, tolerance), "u long, v long"))

    groups = stored(connected(candidates))
    sizes = stored(groups.groupBy(F.col("root").alias("key")).agg(F.count("*").alias("members")))
    members = groups.join(sizes, F.col("root") == F.col("key")).select("key", F.col("node").alias("rep"), "members")
    # the texts of the kinds in groups: of the ids that stand for them; other texts of these ids meet no kind
    wanted = kinds.join(groups.select(F.col("node").alias("w")), F.col("rep") == F.col("w")).select("kind", "rep", "least")
    ids = stored(wanted.select(F.col("least").alias("w")).distinct())
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = rows.join(ids, F.col("d").eqNullSafe(F.col("w"))).select("text")
    sets = texts.mapInPandas(_sets, "kind binary, shingles binary").join(wanted.select(F.col("kind").alias("k"), "rep"), F.col("kind") == F.col("k"))
    sets = stored(sets.dropDuplicates(["rep"]).select("rep", "shingles").join(reps, "rep"))
    near = _dealt(_placed(members, block).join(sets, "rep"))
    compared = stored(near.select("key", "first", "second", "block", "rep", "sketch", "shingles", "copies").mapInPandas(_links(threshold, tolerance), "rep long, links long, other long"))
    links = compared.groupBy("rep").agg(F.sum("links").alias("links")).withColumnRenamed("rep", "l")
    classes = connected(compared.filter("other is not null").select(F.col("other").alias("u"), F.col("rep").alias("v")))

    known = stored(kinds.join(links, F.col("rep") == F.col("l"), "left").join(classes, F.col("rep") == F.col("node"), "left").withColumn("root", F.coalesce("root", "rep")))
    least = stored(known.groupBy(F.col("root").alias("top")).agg(F.min("least").alias("class_id")))
    known = known.join(least, F.col("root") == F.col("top")).select(F.col("kind").alias("k"), F.col("root").alias("class_row"), "class_id", F.col("least").alias("copy_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = signed_.select("d", "kind", "carried").join(known, F.col("kind") == F.col("k"), "left")
    own = lambda c: F.when(F.col("k").isNull(), F.col("d")).otherwise(F.col(c)).alias(c)
    return out.select(F.col("d").alias("doc_id"), "class_row", own("class_id"), own("copy_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), *[F.col(f"carried.{c}").alias(c) for c in carry])


def op10_similar(spark, sf_dir):
    return similar(table(spark, sf_dir, "documents"))


_LOWERED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '{LETTER_WORD}') AS ws FROM documents WHERE doc_id IS NOT NULL),
s AS (
  SELECT DISTINCT doc_id, list_slice(ws, i, i + {SHINGLE - 1}) AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {SHINGLE - 1}, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT u, v, k, nu.n AS nu, nv.n AS nv FROM p JOIN n nu ON nu.doc_id = u JOIN n nv ON nv.doc_id = v WHERE k * 1000 >= {round(THRESHOLD * 1000)} * (nu.n + nv.n - k)),
r(u, v) AS (SELECT u, v FROM l UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u),
c AS (SELECT u, min(v) AS v FROM r GROUP BY u),
k AS (SELECT u, min(CASE WHEN k = nu AND k = nv THEN v END) AS v, count(*) AS n FROM l GROUP BY u)
SELECT doc_id, least(doc_id, coalesce(c.v, doc_id)) AS class_id, least(doc_id, coalesce(k.v, doc_id)) AS copy_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links
FROM d LEFT JOIN c ON c.u = doc_id LEFT JOIN k ON k.u = doc_id
"""
