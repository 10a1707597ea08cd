"""Documents into linked chunks."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import bpe
from ..work import spread

CHUNK_TOKENS, CHARS_PER_TOKEN = 1000, 4
# Separators from coarse to fine, for prose and for some languages' code.
SEPARATORS = ("\n\n", "\n", ". ", " ", "")
CODE_SEPARATORS = {
    "python": ("\nclass ", "\ndef ", "\n\n", "\n", " ", ""),
    "javascript": ("\nfunction ", "\nconst ", "\n\n", "\n", " ", ""),
    "typescript": ("\nclass ", "\nfunction ", "\n\n", "\n", " ", ""),
    "java": ("\nclass ", "\nvoid ", "\n\n", "\n", " ", ""),
    "rust": ("\nfn ", "\nstruct ", "\n\n", "\n", " ", ""),
}
CHUNK_SCHEMA = "chunk_id string, document_id string, chunk_index int, content string, token_count int, prev_chunk_id string, next_chunk_id string, chunk_type string"
#: Characters of the texts that are cut together: bounds a task's memory besides its longest text.
LOT = 4_000_000
HEADER = r"^(#{1,3}) +(.*)$"


def recursive_split(text: str, limit: int, separators=SEPARATORS, overlap: int = 0, measure: Callable[[str], int] = len) -> list[str]:
    """Pieces of at most `limit` characters whose concatenation is the text (with no overlap).

    Parts cut after the coarsest separator are packed greedily; a part too long by itself is cut by the
    next one. With an overlap each piece also repeats whole trailing parts of the one before, up to so many characters.
    Another measure than characters may be given; then `limit` and `overlap` are in its units.
    """
    out: list[str] = []
    held: list[str] = []
    size = 0

    def flush() -> None:
        nonlocal held, size
        if held:
            out.append("".join(held))
        back: list[str] = []
        if overlap:
            room = overlap
            for part in reversed(held):
                if measure(part) > room:
                    break
                back.insert(0, part)
                room -= measure(part)
        held, size = back, sum(map(measure, back))

    todo = [(text, 0)]
    while todo:
        part, level = todo.pop()
        length = measure(part)
        if length <= limit:
            if size + length > limit and size:
                flush()
                if size + length > limit:
                    held, size = [], 0
            if part:
                held.append(part)
                size += length
            continue
        while level < len(separators) and separators[level] and separators[level] not in part:
            level += 1  # nothing to cut: measured once
        mark = separators[level] if level < len(separators) else ""
        if mark:
            cuts = part.split(mark)
            parts = [x + mark for x in cuts[:-1]] + [cuts[-1]]
        else:
            step = limit if len(part) > limit else (len(part) + 1) // 2
            parts = [part[i : i + step] for i in range(0, len(part), step)]
        todo.extend((x, level + 1) for x in reversed(parts) if x)
    if size:
        out.append("".join(held))
    return out


def _links(document_id: str | None, contents: list[str], kind: str) -> list[tuple]:
    """Rows of linked chunks for one document's pieces in order."""
    ids = [hashlib.sha256(":".join(x for x in (document_id, str(i)) if x is not None).encode()).hexdigest() for i in range(len(contents))]
    return [(ids[i], document_id, i, piece, len(piece) // CHARS_PER_TOKEN, ids[i - 1] if i else None, ids[i + 1] if i + 1 < len(ids) else None, kind) for i, piece in enumerate(contents)]


def _lots(batches: Iterator[pd.DataFrame], text: str = "content") -> Iterator[pd.DataFrame]:
    """Some rows at a time: about LOT characters, or one text."""
    for batch in batches:
        size = batch[text].map(lambda x: len(x) if isinstance(x, str) else 0).cumsum().to_numpy() if len(batch) else []
        begin, held = 0, 0
        for i in range(len(size)):
            if size[i] - held >= LOT or i + 1 == len(size):
                yield batch.iloc[begin : i + 1]
                begin, held = i + 1, size[i]


def _cut(docs: DataFrame, cut: Callable[[str], list[str]], kind: str) -> DataFrame:
    """docs(document_id, content) -> linked chunks; blank pieces go. Each document is cut, numbered and linked in the task that reads it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _lots(batches):
            rows = [row for d, text in zip(batch["document_id"], batch["content"], strict=True) for row in _links(d, [p for p in cut(text or "") if p.strip()], kind)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CHUNK_SCHEMA.split(", ")])

    return docs.select(F.col("document_id").cast("string"), "content").mapInPandas(run, CHUNK_SCHEMA)


def recursive_chunks(docs: DataFrame, chunk_tokens: int = CHUNK_TOKENS, overlap_tokens: int = 0, language: str | None = None) -> DataFrame:
    """docs(document_id, content) -> linked chunks."""
    separators = CODE_SEPARATORS.get(language, SEPARATORS) if language else SEPARATORS
    limit, overlap = chunk_tokens * CHARS_PER_TOKEN, overlap_tokens * CHARS_PER_TOKEN
    return _cut(docs, lambda t: recursive_split(t, limit, separators, overlap), "recursive")


def token_split(text: str, limit: int, count: bpe.Counter, separators=SEPARATORS) -> list[str]:
    """Pieces of at most `limit` tokens whose concatenation is the text."""
    return [piece for piece, _ in _token_pieces(text, limit, count, separators)]


def _token_pieces(text: str, limit: int, count: bpe.Counter, separators) -> list[tuple[str, int]]:
    """The pieces of token_split and their numbers of tokens.

    Cut as recursive_split does, in tokens; a part that no separator cuts, and the rare piece that has more tokens than
    its parts together, is halved. A single character stays whole whatever it takes. What is over the limit is counted
    only until it is.
    """
    out: list[tuple[str, int]] = []
    todo = list(reversed(recursive_split(text, limit, separators[:-1], measure=lambda part: count.up_to(part, limit) if len(part) > 1 else 1)))
    while todo:
        piece = todo.pop()
        n = count.up_to(piece, limit)
        if len(piece) < 2 or n <= limit:
            out.append((piece, n))
        else:
            half = len(piece) // 2
            todo += [piece[half:], piece[:half]]
    return out


def token_chunks(docs: DataFrame, vocabulary: str, chunk_tokens: int = CHUNK_TOKENS, language: str | None = None) -> DataFrame:
    """docs(document_id, content) -> linked chunks of at most chunk_tokens tokens of a byte-pair vocabulary, whose number is token_count."""
    counter = bpe.vocabulary(docs.sparkSession, vocabulary)
    separators = CODE_SEPARATORS.get(language, SEPARATORS) if language else SEPARATORS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter()
        for batch in _lots(batches):
            rows, lengths = [], []
            for d, text in zip(batch["document_id"], batch["content"], strict=True):
                pieces = [(p, n) for p, n in _token_pieces(text or "", chunk_tokens, count, separators) if p.strip()]
                rows += _links(d, [p for p, _ in pieces], "token")
                lengths += [n for _, n in pieces]
            chunks = pd.DataFrame(rows, columns=[c.split()[0] for c in CHUNK_SCHEMA.split(", ")])
            chunks["token_count"] = np.array(lengths, np.int32)
            yield chunks

    # counting takes far longer than dealing the texts out
    return spread(docs.select(F.col("document_id").cast("string"), "content")).mapInPandas(run, CHUNK_SCHEMA)


def markdown_sections(docs: DataFrame) -> DataFrame:
    """docs(document_id, content) -> (document_id, chunk_index, header_path, content): one row for each section with text."""
    rows = docs.select(F.col("document_id").cast("string").alias("document_id"), F.posexplode(_sections(F.col("content"))).alias("chunk_index", "s"))
    return rows.select("document_id", "chunk_index", "s.header_path", "s.content")


def _sections(content: Column) -> Column:
    """The sections of a markdown text that have text, with their headers' path.

    A header's context is the last header of each shallower level since the one before that. All in one
    document's array, so nothing is shuffled: folded line by line.
    """
    lines = F.split(F.coalesce(content, F.lit("")), "\n")
    level = lambda x: F.char_length(F.regexp_extract(x, HEADER, 1))
    empty = F.struct(F.lit("").alias("h1"), F.lit("").alias("h2"), F.lit("").alias("h3"), F.lit("").alias("path"), F.lit("").alias("body"))
    start = F.struct(empty.alias("now"), F.array().cast("array<struct<h1:string,h2:string,h3:string,path:string,body:string>>").alias("done"))

    def step(acc, x):
        now = acc["now"]
        n, title = level(x), F.btrim(F.regexp_extract(x, HEADER, 2))
        h1 = F.when(n == 1, title).otherwise(now["h1"])
        h2 = F.when(n == 2, title).when(n == 1, F.lit("")).otherwise(now["h2"])
        h3 = F.when(n == 3, title).when(n.isin(1, 2), F.lit("")).otherwise(now["h3"])
        path = F.array_join(F.filter(F.array(h1, h2, h3), lambda h: h != ""), " > ")
        opened = F.struct(h1.alias("h1"), h2.alias("h2"), h3.alias("h3"), path.alias("path"), F.lit("").alias("body"))
        more = F.struct(now["h1"].alias("h1"), now["h2"].alias("h2"), now["h3"].alias("h3"), now["path"].alias("path"), F.concat(now["body"], x, F.lit("\n")).alias("body"))
        return F.when(n > 0, F.struct(opened.alias("now"), F.concat(acc["done"], F.array(now)).alias("done"))).otherwise(F.struct(more.alias("now"), acc["done"].alias("done")))

    sections = F.aggregate(lines, start, step, lambda acc: F.filter(F.concat(acc["done"], F.array(acc["now"])), lambda s: F.btrim(F.regexp_replace(s["body"], r"\s+", " ")) != ""))
    return F.transform(sections, lambda s: F.struct(s["path"].alias("header_path"), F.regexp_replace(s["body"], r"^\s+|\s+$", "").alias("content")))


def pack_paragraphs(text: str, limit: int, context: str) -> list[str]:
    """Paragraphs packed up to limit; each further piece starts with the last two paragraphs of the one before."""
    lead = f"# {context}\n\n" if context else ""
    pieces, held, fresh = [], [], 0
    for p in (x for x in re.split(r"\n\s*\n", text) if x.strip()):
        if fresh and len("\n\n".join([*held, p])) > limit:
            pieces.append(lead + "\n\n".join(held))
            held, fresh = held[-2:], 0
        held.append(p)
        fresh += 1
    if fresh:
        pieces.append(lead + "\n\n".join(held))
    return pieces


def markdown_chunks(docs: DataFrame, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """Markdown documents into chunks that carry their headers; long sections are packed by paragraphs."""
    limit = chunk_tokens * CHARS_PER_TOKEN

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for d, sections in zip(batch["document_id"], batch["sections"], strict=True):
                pieces = []
                for section in sections:
                    context, body = section["header_path"], section["content"]
                    pieces += [f"# {context}\n\n{body}" if context else body] if len(body) <= limit else pack_paragraphs(body, limit, context)
                rows += _links(d, pieces, "markdown")
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CHUNK_SCHEMA.split(", ")])

    return docs.select(F.col("document_id").cast("string").alias("document_id"), _sections(F.col("content")).alias("sections")).mapInPandas(run, CHUNK_SCHEMA)


def length_chunks(docs: DataFrame, min_chars: int = 100) -> DataFrame:
    """Sentences packed until a piece has at least min_chars; a short rest joins the piece before. Native fold."""
    from ..functions.text import sentences

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(acc, s):
        now = F.when(acc["now"] == "", s).otherwise(F.concat_ws(" ", acc["now"], s))
        full = F.char_length(now) >= min_chars
        return F.when(full, F.struct(F.concat(acc["done"], F.array(now)).alias("done"), F.lit("").alias("now"))).otherwise(F.struct(acc["done"].alias("done"), now.alias("now")))

    def end(acc):
        last = F.coalesce(F.try_element_at(acc["done"], F.lit(-1)), F.lit(""))
        joined = F.concat(F.slice(acc["done"], F.lit(1), F.greatest(F.size(acc["done"]) - 1, F.lit(0))), F.array(F.btrim(F.concat_ws(" ", last, acc["now"]))))
        return F.when(acc["now"] == "", acc["done"]).otherwise(joined)

    pieces = F.aggregate(sentences(F.coalesce("content", F.lit(""))), start, step, end)
    named = docs.select(F.col("document_id").cast("string").alias("document_id"), pieces.alias("pieces"))
    key = lambda i: F.sha2(F.concat_ws(":", "document_id", i.cast("string")), 256)
    rows = named.select("document_id", F.size("pieces").alias("n"), F.posexplode("pieces").alias("chunk_index", "content"))
    at = F.col("chunk_index")
    return rows.select(
        key(at).alias("chunk_id"), "document_id", "chunk_index", "content", F.floor(F.char_length("content") / CHARS_PER_TOKEN).cast("int").alias("token_count"),
        F.when(at > 0, key(at - 1)).alias("prev_chunk_id"), F.when(at + 1 < F.col("n"), key(at + 1)).alias("next_chunk_id"), F.lit("semantic").alias("chunk_type"),
    )


def semantic_chunks(sentence_vectors: DataFrame, threshold: float = 0.5, min_chars: int = 100) -> DataFrame:
    """sentence_vectors(document_id, position, sentence, embedding) -> chunks.

    A sentence unlike the one before (cosine below threshold) begins a chunk; a chunk under min_chars joins the one before.
    """
    from .vectors import cosine

    w = W.partitionBy("document_id").orderBy("position")
    like = cosine(F.lag("embedding").over(w), F.col("embedding"))
    rows = sentence_vectors.withColumn("_new", F.coalesce((like < threshold).cast("int"), F.lit(0)))
    rows = rows.withColumn("_group", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    pieces = rows.groupBy("document_id", "_group").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "sentence"))), lambda x: x["sentence"]), " ").alias("content"))
    v = W.partitionBy("document_id").orderBy("_group")
    long = (F.char_length("content") >= min_chars).cast("int")
    pieces = pieces.withColumn("_piece", F.greatest(F.sum(long).over(v.rowsBetween(W.unboundedPreceding, W.currentRow)), F.lit(1)))
    out = pieces.groupBy("document_id", F.col("_piece").alias("chunk_index")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_group", "content"))), lambda x: x["content"]), " ").alias("content"))
    return linked(out.withColumn("chunk_type", F.lit("semantic")))


def linked(chunks: DataFrame, carry: list[str] = ()) -> DataFrame:
    """For chunks that no one task has cut: consecutive indexes from 0, ids made of document and index, token counts, and links to both neighbours."""
    w = W.partitionBy("document_id").orderBy("chunk_index")
    rows = chunks.withColumn("chunk_index", (F.row_number().over(w) - 1).cast("int"))
    rows = rows.withColumn("chunk_id", F.sha2(F.concat_ws(":", "document_id", F.col("chunk_index").cast("string")), 256))
    rows = rows.withColumns({"prev_chunk_id": F.lag("chunk_id").over(w), "next_chunk_id": F.lead("chunk_id").over(w), "token_count": F.floor(F.char_length("content") / CHARS_PER_TOKEN).cast("int")})
    return rows.select("chunk_id", "document_id", "chunk_index", "content", "token_count", "prev_chunk_id", "next_chunk_id", "chunk_type", *carry)


def with_neighbours(chunks: DataFrame, hits: DataFrame, reach: int = 1) -> DataFrame:
    """hits(query_id, document_id, chunk_index) -> each hit's chunk and those within reach of it, once for each query."""
    around = hits.select("query_id", "document_id", F.explode(F.sequence(F.col("chunk_index") - reach, F.col("chunk_index") + reach)).alias("chunk_index")).distinct()
    return around.join(chunks, ["document_id", "chunk_index"])
