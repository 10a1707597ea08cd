"""A stored full-text index: postings by term, in blocks that say the greatest and least value within them.

Texts are split once, when they are added. A search reads the blocks of its questions' terms only, and of those only
the ones that can hold a hit among the best k: the blocks' own bounds tell. Results equal fulltext.search().
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..work import stored
from . import fulltext
from .versions import Versions

BUCKETS = 32
#: Postings of a block and places of their words, about, and steps of value that a block's postings may differ by.
BLOCK, PLACES, STEPS = 1024, 8_192, 8
#: Postings that a task holds to put those of a term together.
HELD = 262_144
#: Bytes of a row group of a segment, and rows after which its size is looked at: a scan holds whole groups of long lists.
GROUP, LOOK = 4 << 20, 1_000
#: Deleted ids that are broadcast at most.
BROADCAST_IDS = 1_000_000
#: How a segment's columns are laid out.
FORM = 2
#: So many terms at most are named in the scan's filter; more are joined only.
NAMED_TERMS = 1000
#: Words of the chunks whose places are found together: bounds a task's memory besides its longest chunk.
LOT = 262_144


def _lots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Some rows at a time: LOT words, or one chunk."""
    for batch in batches:
        size = sum(pc.fill_null(pc.list_value_length(batch.column(x)), 0).to_numpy() for x in ("title", "content"))
        lot = (np.cumsum(size) - size) // LOT
        ends = [*np.flatnonzero(np.diff(lot, append=-1)) + 1]
        for begin, end in zip([0, *ends], ends):
            yield batch.slice(begin, end - begin)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk_id, title, content) with lists of terms -> (chunk_id, term, at_title, at_content)."""
    for batch in _lots(batches):
        sizes = [pc.list_value_length(batch.column(x)).to_numpy() for x in ("title", "content")]
        row = np.concatenate([np.repeat(np.arange(len(n)), n) for n in sizes])
        at = np.concatenate([np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) for n in sizes]).astype(np.int32)
        in_title = np.arange(len(row)) < sizes[0].sum()
        terms = pa.concat_arrays([batch.column(x).flatten() for x in ("title", "content")]).dictionary_encode()
        key = row * max(len(terms.dictionary), 1) + terms.indices.to_numpy()
        order = np.argsort(key, kind="stable")  # of a term in a chunk the title's places come first, then the content's, each in order
        begins = np.flatnonzero(np.diff(key[order], prepend=-1))
        posting = np.repeat(np.arange(len(begins)), np.diff(begins, append=len(order)))
        lists = []
        for mine in (in_title[order], ~in_title[order]):
            ends = np.cumsum(np.bincount(posting[mine], minlength=len(begins)))
            lists.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(at[order][mine])))
        head = order[begins]
        yield pa.RecordBatch.from_arrays([batch.column("chunk_id").take(pa.array(row[head])), terms.dictionary.take(terms.indices.take(pa.array(head))), *lists], ["chunk_id", "term", "at_title", "at_content"])


def _postings(chunks: DataFrame, english: bool) -> DataFrame:
    """(chunk_id, term, at_title, at_content): places of each term of each chunk, found where the chunk is read."""
    terms = fulltext.english_terms if english else fulltext.words
    title = terms(F.col("title")) if "title" in chunks.columns else F.array().cast("array<string>")
    split = chunks.select("chunk_id", title.alias("title"), terms(F.col("content")).alias("content"))
    return split.mapInArrow(_places, f"chunk_id {dict(chunks.dtypes)['chunk_id']}, term string, at_title array<int>, at_content array<int>")


def _held(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Batches put together until they have so many rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= most:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def _value(in_title: np.ndarray, in_content: np.ndarray) -> np.ndarray:
    return fulltext.TITLE_WEIGHT * np.log1p(in_title) + fulltext.CONTENT_WEIGHT * np.log1p(in_content)


def _lists(ends: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), values)


def _grouped(most: int):
    """Batches of (chunk_id, term, at_title, at_content) -> a row for each term and step of value of `most` postings and more.

    Of a row's postings `ids` has the chunks, `titles` the number of a title's places and `ends` where in `places` their places
    end, the title's first: flat lists, as a list in a list takes four times the memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _held(batches, most):
            if not len(held):
                continue
            ids, term, *places = (held.column(x).combine_chunks() for x in ("chunk_id", "term", "at_title", "at_content"))
            sizes = [pc.list_value_length(x).to_numpy().astype(np.int64) for x in places]
            step = np.floor(_value(*sizes) * STEPS).astype(np.int64)
            terms = term.dictionary_encode()
            key = terms.indices.to_numpy().astype(np.int64) * (step.max() + 1) + step
            order = np.argsort(key, kind="stable")
            begins = np.flatnonzero(np.diff(key[order], prepend=-1))
            # places of a posting's title, then of its content, posting by posting
            begin = [np.cumsum(n) - n for n in sizes]
            begin[1] += sizes[0].sum()
            both, length = (np.stack([x[order] for x in pair], 1).ravel() for pair in (begin, sizes))
            at = np.arange(length.sum()) + np.repeat(both - (np.cumsum(length) - length), length)
            flat = pa.concat_arrays([x.flatten() for x in places]).take(pa.array(at))
            size = (sizes[0] + sizes[1])[order]
            ends = np.cumsum(size)
            first = np.repeat((ends - size)[begins], np.diff(begins, append=len(order)))
            last = np.append(begins[1:], len(order))
            head, upto = order[begins], ends[last - 1]
            yield pa.RecordBatch.from_arrays(
                [terms.dictionary.take(terms.indices.take(pa.array(head))), pa.array(step[head].astype(np.int32))]
                + [_lists(last, ids.take(pa.array(order))), _lists(last, pa.array(sizes[0][order].astype(np.int32))), _lists(last, pa.array((ends - first).astype(np.int32))), _lists(upto, flat)],
                ["term", "step", "ids", "titles", "ends", "places"],
            )

    return run


def _merged(block: int, places: int):
    """Rows of _grouped(), those of a term and step one after another -> blocks of at most about `block` postings and `places` places.

    The lists of rows that follow one another lie one after another already: only where they begin is made anew.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            term = batch.column("term").dictionary_encode()
            n, m = (pc.list_value_length(batch.column(x)).to_numpy().astype(np.int64) for x in ("ids", "places"))
            ids, titles, ends, flat = (batch.column(x).flatten() for x in ("ids", "titles", "ends", "places"))
            row = np.repeat(np.arange(len(n)), n)
            ends = ends.to_numpy() + (np.cumsum(m) - m)[row]
            size = np.diff(ends, prepend=0)
            key = term.indices.to_numpy().astype(np.int64)[row] * (1 << 32) + batch.column("step").to_numpy()[row]
            fresh = np.diff(key, prepend=-1) != 0
            since = np.maximum.accumulate(np.where(fresh, np.arange(len(row)), 0))
            full = (np.arange(len(row)) - since) // block
            spent = (ends - size - (ends - size)[since]) // places
            begins = np.flatnonzero(fresh | (np.diff(full, prepend=0) != 0) | (np.diff(spent, prepend=0) != 0))
            last = np.append(begins[1:], len(row))
            first = np.repeat((ends - size)[begins], last - begins)
            head = pa.array(row[begins])
            value = _value(titles.to_numpy(), size - titles.to_numpy())
            bounds = [pa.array(x.reduceat(value, begins)) for x in (np.maximum, np.minimum)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("bucket").take(head), term.dictionary.take(term.indices.take(head)), pa.array(last - begins), *bounds]
                + [_lists(last, ids), _lists(last, titles), _lists(last, pa.array((ends - first).astype(np.int32))), _lists(ends[last - 1], flat)],
                ["bucket", "term", "n", "most", "least", "ids", "titles", "ends", "places"],
            )

    return run


def _lots_of(postings: DataFrame) -> DataFrame:
    """Postings put together by term and step of value where they are."""
    return postings.mapInArrow(_grouped(HELD), f"term string, step int, {_flat(dict(postings.dtypes)['chunk_id'])}")


def _flat(chunk_id: str) -> str:
    return f"ids array<{chunk_id}>, titles array<int>, ends array<int>, places array<int>"


def _blocks(lots: DataFrame) -> DataFrame:
    """Blocks of the rows of _lots_of() as they lie in tasks: a task sorts its own."""
    bucket = F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int").alias("bucket")
    ids = dict(lots.dtypes)["ids"].removeprefix("array<").removesuffix(">")
    rows = lots.select(bucket, "*").sortWithinPartitions("bucket", "term", "step")
    made = rows.mapInArrow(_merged(BLOCK, PLACES), f"bucket int, term string, n long, most double, least double, {_flat(ids)}")
    return made.withColumn("block", F.monotonically_increasing_id().cast("string"))


def _exploded(blocks: DataFrame) -> DataFrame:
    """(seq, term, chunk_id, at_title, at_content) of blocks."""
    rows = blocks.select("seq", "term", "titles", "ends", "places", F.posexplode("ids").alias("_i", "chunk_id"))
    begin = F.when(F.col("_i") == 0, 0).otherwise(F.col("ends")[F.col("_i") - 1])
    rows = rows.withColumn("_titles", F.col("titles")[F.col("_i")])
    at_title = F.slice("places", begin + 1, F.col("_titles"))
    at_content = F.slice("places", begin + F.col("_titles") + 1, F.col("ends")[F.col("_i")] - begin - F.col("_titles"))
    return rows.select("seq", "term", "chunk_id", at_title.alias("at_title"), at_content.alias("at_content"))


class TextIndex:
    """An index at a shared path: segments of added chunks, lists of deleted ones, and versions that name them in order."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.versions = spark, path.rstrip("/"), Versions(spark, path)
        if not self.versions.latest():
            raise ValueError(f"there is no index at {path}")
        first = self.versions.read(1)
        if first.get("form") != FORM:
            raise ValueError(f"the index at {path} was stored in another form: it must be built again")
        self.english = first["english"]

    @classmethod
    def create(cls, spark: SparkSession, path: str, english: bool = False) -> TextIndex:
        if not Versions(spark, path).commit(1, {"english": english, "form": FORM, "parts": []}):
            raise ValueError(f"there is an index at {path}")
        return cls(spark, path)

    def _commit(self, part: dict) -> None:
        """Put a written part at the end. Parts of other writers do not hinder it: it goes after them."""
        while True:
            now = self.versions.latest()
            state = self.versions.read(now)
            if self.versions.commit(now + 1, state | {"parts": [*state["parts"], part]}):
                return

    def _write(self, blocks: DataFrame) -> str:
        at = f"segments/{uuid.uuid4().hex}"
        blocks.write.options(**{"compression": "zstd", "parquet.block.size": GROUP, "parquet.page.size.row.check.min": LOOK, "parquet.page.size.row.check.max": LOOK}).parquet(f"{self.path}/{at}")
        return at

    def add(self, chunks: DataFrame) -> None:
        """Index chunks(chunk_id, content[, title]) where they are read. A chunk that is indexed already must be deleted first."""
        self._commit({"segment": self._write(_blocks(_lots_of(_postings(chunks, self.english))))})

    def delete(self, ids: DataFrame) -> None:
        """Take chunks(chunk_id) out: their postings are passed over from now on, and go with compact()."""
        at = f"deleted/{uuid.uuid4().hex}"
        ids.select("chunk_id").distinct().write.parquet(f"{self.path}/{at}")
        self._commit({"deleted": at})

    def _read(self, parts: list[dict]) -> tuple[DataFrame | None, DataFrame | None]:
        """(blocks with `seq`, deleted ids with `seq`); a deletion counts for segments before it."""
        found: list[DataFrame | None] = []
        for kind in ("segment", "deleted"):
            rows = None
            for i, part in enumerate(parts):
                if kind in part:
                    one = self.spark.read.parquet(f"{self.path}/{part[kind]}").withColumn("seq", F.lit(i))
                    rows = one if rows is None else rows.unionByName(one)
            found.append(rows)
        return found[0], found[1]

    @staticmethod
    def _live(postings: DataFrame, deleted: DataFrame | None) -> DataFrame:
        if deleted is None:
            return postings
        gone = fulltext._few(deleted.groupBy(F.col("chunk_id").alias("_c")).agg(F.max("seq").alias("_seq")), BROADCAST_IDS)
        return postings.join(gone, F.col("chunk_id") == F.col("_c"), "left").filter("_seq is null or _seq < seq").drop("_c", "_seq")

    def compact(self) -> None:
        """Merge all segments into one without what was deleted, each task the files that it reads. Parts added meanwhile stay."""
        done = self.versions.read()["parts"]
        blocks, deleted = self._read(done)
        if blocks is None:
            return
        last = max((i for i, part in enumerate(done) if "deleted" in part), default=-1)  # segments before it may have lost chunks
        step = F.floor(F.col("least") * STEPS).cast("int").alias("step")
        rows = blocks.filter(F.col("seq") > last).select("term", step, "ids", "titles", "ends", "places")
        if deleted is not None:
            rows = rows.unionByName(_lots_of(self._live(_exploded(blocks.filter(F.col("seq") <= last)), deleted).drop("seq")))
        part = {"segment": self._write(_blocks(rows))}
        while True:
            now = self.versions.latest()
            state = self.versions.read(now)
            if state["parts"][: len(done)] != done:
                return  # another writer compacted first
            if self.versions.commit(now + 1, state | {"parts": [part, *state["parts"][len(done) :]]}):
                return

    def search(self, queries: DataFrame, k: int | None = 20, skip: bool = True) -> DataFrame:
        """queries(query_id, query) -> (query_id, chunk_id, rank_score, rank), as fulltext.search() of the live chunks.

        With k, blocks that cannot hold any of a question's best k are not read (skip=False reads all): a block's greatest value,
        with the greatest values of the question's other phrases, must reach the k-th best of one of its single words. After
        deletions, until compact(), nothing is skipped, as blocks' counts may be too high.
        """
        asked = stored(fulltext.asked_phrases(queries, self.english))
        blocks, deleted = self._read(self.versions.read()["parts"])
        phrases = asked.select("phrase").distinct()
        terms = phrases.select(F.explode("phrase").alias("term")).distinct()
        if blocks is None:
            return fulltext.scored(asked, self._empty(queries), k)
        few = terms.limit(NAMED_TERMS + 1).collect()
        if len(few) <= NAMED_TERMS:
            blocks = blocks.filter(F.col("term").isin([r.term for r in few])).filter(F.col("bucket").isin(sorted({r.b for r in terms.select(F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int").alias("b")).distinct().collect()})))
        else:
            blocks = blocks.join(terms, "term", "left_semi")
        if k is not None and skip and deleted is None:
            blocks = blocks.join(self._needed(asked, blocks.select("seq", "term", "block", "n", "most", "least"), k), ["seq", "term", "block"], "left_semi")
        rows = self._live(_exploded(blocks), deleted)
        return fulltext.scored(asked, self._hits(rows, phrases), k)

    def _empty(self, queries: DataFrame) -> DataFrame:
        return queries.limit(0).select(F.array(F.lit("")).alias("phrase"), F.lit(0).cast("long").alias("chunk_id"), F.lit(0).cast("long").alias("in_title"), F.lit(0).cast("long").alias("in_content"))

    @staticmethod
    def _needed(asked: DataFrame, heads: DataFrame, k: int) -> DataFrame:
        """(seq, term, block) of the blocks that some question may need, from the blocks' bounds alone."""
        heads = stored(heads)
        best = heads.groupBy("term").agg(F.max("most").alias("best"))
        words = asked.select("query_id", "clause", "n_phrases", "phrase", F.explode(F.array_distinct("phrase")).alias("term"))
        # a phrase is worth its rarest word's best value at most
        worth = words.join(best, "term").groupBy("query_id", "clause", "phrase").agg(F.min("best").alias("worth"))
        total = worth.groupBy("query_id").agg(F.sum("worth").alias("total"))
        # the k-th best of a word that is an alternative of its own: the least value of the blocks that hold k postings
        best_first = W.partitionBy("term").orderBy(F.desc("least"), "seq", "block").rowsBetween(W.unboundedPreceding, 0)
        reached = heads.withColumn("_upto", F.sum("n").over(best_first)).filter(F.col("_upto") >= k).groupBy("term").agg(F.max("least").alias("kth"))
        alone = words.filter((F.col("n_phrases") == 1) & (F.size("phrase") == 1))
        bound = alone.join(reached, "term").groupBy("query_id").agg(F.max("kth").alias("bound"))
        rows = words.join(worth, ["query_id", "clause", "phrase"]).join(total, "query_id").join(bound, "query_id", "left")
        limits = rows.groupBy("term").agg(F.min(F.coalesce("bound", F.lit(0.0)) - (F.col("total") - F.col("worth"))).alias("limit"))
        return heads.join(limits, "term").filter(F.col("most") >= F.col("limit") - 1e-9).select("seq", "term", "block")

    @staticmethod
    def _hits(rows: DataFrame, phrases: DataFrame) -> DataFrame:
        """(phrase, chunk_id, in_title, in_content) from postings of words; words of longer phrases must stand one after another."""
        single = phrases.filter(F.size("phrase") == 1).select("phrase", F.col("phrase")[0].alias("term"))
        out = rows.join(single, "term").select("phrase", "chunk_id", F.size("at_title").cast("long").alias("in_title"), F.size("at_content").cast("long").alias("in_content"))
        longer = phrases.filter(F.size("phrase") > 1).select("phrase", F.posexplode("phrase").alias("at", "term"))
        begins = lambda places: F.transform(places, lambda x: x - F.col("at"))
        spots = rows.join(longer, "term").select("phrase", "chunk_id", "at", begins(F.col("at_title")).alias("t"), begins(F.col("at_content")).alias("c"))
        # where each word says that the phrase begins; it does where all agree
        lists = spots.groupBy("phrase", "chunk_id").agg(F.collect_list("t").alias("ts"), F.collect_list("c").alias("cs")).filter(F.size("ts") == F.size("phrase"))
        agreed = lambda lists: F.size(F.aggregate(F.slice(lists, 2, F.size(lists)), lists[0], F.array_intersect)).cast("long")
        whole = lists.select("phrase", "chunk_id", agreed(F.col("ts")).alias("in_title"), agreed(F.col("cs")).alias("in_content")).filter("in_title + in_content > 0")
        return out.unionByName(whole)
