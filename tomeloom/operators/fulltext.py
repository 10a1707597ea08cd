"""Full-text search of a table of queries over a table of chunks, as joins of terms."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..work import stored

#: Weights of a title's and a content's terms.
TITLE_WEIGHT, CONTENT_WEIGHT = 1.0, 0.4
#: Distinct query terms that are broadcast at most.
BROADCAST_TERMS = 1_000_000

_word = re.compile(r"[^\W_]+")
_part = re.compile(r'"([^"]*)"|(\S+)')


def parse(query: str) -> list[list[tuple[str, ...]]]:
    """A query as alternatives of phrases that must all match; a word is a phrase of one.

    OR parts alternatives; AND and mere adjacency join; quotes make phrases; operators in any case; no
    NOT, no parentheses: what isn't a word is left out.
    """
    clauses: list[list[tuple[str, ...]]] = [[]]
    for quoted, bare in _part.findall(query or ""):
        if bare.upper() == "OR":
            clauses.append([])
        elif bare.upper() != "AND":
            words = tuple(_word.findall((quoted or bare).lower()))
            if quoted:
                clauses[-1] += [words] if words else []
            else:
                clauses[-1] += [(w,) for w in words]
    return [c for c in clauses if c]


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for q, text in zip(batch["query_id"], batch["query"], strict=True):
            for c, clause in enumerate(parse(text)):
                needed = sorted(set(clause))
                for p, phrase in enumerate(needed):
                    rows += [(q, c, len(needed), p, len(phrase), i, w) for i, w in enumerate(phrase)]
        yield pd.DataFrame(rows, columns=["query_id", "clause", "n_phrases", "phrase", "n_words", "at", "term"])


def query_terms(queries: DataFrame) -> DataFrame:
    """queries(query_id, query) -> one row for each word of each phrase of each alternative."""
    return queries.select("query_id", "query").mapInPandas(_parsed, f"query_id {dict(queries.dtypes)['query_id']}, clause int, n_phrases int, phrase int, n_words int, at int, term string")


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


# English words that searches pass over, and suffixes that stems lose, longest first, with what stands for them.
STOP_WORDS = frozenset("a about after all also an and any are as at be because been before but by can could did do does for from had has have he her his how i if in into is it its just me more most my no not of on only or other our out over she should so some such than that the their them then there these they this those through to too under up very was we were what when where which while who why will with would you your".split())
STEM_SUFFIXES = (("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("ization", "ize"), ("tional", "tion"), ("biliti", "ble"), ("sses", "ss"), ("ement", ""), ("ation", "ate"), ("ies", "i"), ("ing", ""), ("ed", ""), ("ly", ""), ("s", ""))
STEM_LEAST = 3


def stem(word: Column) -> Column:
    """A word without its first fitting suffix, if STEM_LEAST letters with a vowel stay; a word that ends in ss, us or is keeps its s."""
    out = F
    for suffix, instead in STEM_SUFFIXES:
        left = F.substring(word, F.lit(1), F.char_length(word) - len(suffix))
        fits = F.endswith(word, F.lit(suffix)) & (F.char_length(left) >= STEM_LEAST) & F.rlike(left, F.lit("[aeiouy]"))
        if suffix == "s":
            fits &= ~F.rlike(word, F.lit("(ss|us|is)$"))
        out = out.when(fits, F.concat(left, F.lit(instead)))
    return out.otherwise(word)


def english_terms(text: Column) -> Column:
    """Lower-cased words without stop words, stemmed, in order."""
    return F.transform(F.filter(words(text), lambda w: ~w.isin(*sorted(STOP_WORDS))), stem)


def _few(df: DataFrame, limit: int = BROADCAST_TERMS) -> DataFrame:
    """df with a broadcast hint if a count allows it."""
    return F.broadcast(df) if df.count() <= limit else df


def phrase_hits(chunks: DataFrame, phrases: DataFrame, english: bool = False) -> DataFrame:
    """phrases(phrase: array of words), distinct -> (phrase, chunk_id, in_title, in_content): how often each occurs.

    A single word is counted where the chunk is read, so a row for each word of each chunk is the most that
    is shuffled. A longer phrase meets the chunks by its pairs of neighbouring words; only such pairs as
    some phrase has are shuffled.
    """
    terms = english_terms if english else words
    fields = [("content", False)] + ([("title", True)] if "title" in chunks.columns else [])
    parts = [chunks.select("chunk_id", F.lit(title).alias("title"), terms(F.col(name)).alias("ws")) for name, title in fields]
    read = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    counted = lambda df: df.groupBy("phrase", "chunk_id").agg(F.count_if("title").alias("in_title"), F.count_if(~F.col("title")).alias("in_content"))
    single = _few(phrases.filter(F.size("phrase") == 1).select("phrase", F.col("phrase")[0].alias("term")))
    out = counted(read.select("chunk_id", "title", F.explode("ws").alias("term")).join(single, "term"))
    longer = phrases.filter(F.size("phrase") > 1)
    pairs = lambda ws: F.arrays_zip(F.slice(ws, 1, F.greatest(F.size(ws) - 1, F.lit(0))).alias("a"), F.slice(ws, 2, F.greatest(F.size(ws) - 1, F.lit(0))).alias("b"))
    asked = longer.select("phrase", F.posexplode(pairs(F.col("phrase"))).alias("at", "p")).select("phrase", "at", "p.*")
    if asked.isEmpty():
        return out
    spots = read.select("chunk_id", "title", F.posexplode(pairs(F.col("ws"))).alias("pos", "p")).select("chunk_id", "title", "pos", "p.*").join(_few(asked), ["a", "b"])
    # a phrase stands where all its pairs do, at one distance from their places in it
    whole = spots.groupBy("phrase", "chunk_id", "title", (F.col("pos") - F.col("at")).alias("start")).agg(F.count("*").alias("n")).filter(F.col("n") == F.size("phrase") - 1)
    return out.unionByName(counted(whole))


def search(queries: DataFrame, chunks: DataFrame, k: int | None = 20, document_ids: DataFrame | None = None, english: bool = False) -> DataFrame:
    """queries(query_id, query) x chunks(chunk_id, content[, title, document_id]) -> (query_id, chunk_id, rank_score, rank).

    A chunk matches if all phrases of an alternative occur, in content or title. Its score is
    r / (r + 1), r the weighted sum of ln(1 + occurrences) over the query's phrases. Ties by chunk id. With
    english, stop words are passed over and words are compared by their stems.

    Phrases are looked up once however many questions ask them; questions are joined last.
    """
    if document_ids is not None:
        chunks = chunks.join(document_ids.select("document_id").distinct(), "document_id", "left_semi")
    asked = stored(asked_phrases(queries, english))
    return scored(asked, phrase_hits(chunks, asked.select("phrase").distinct(), english), k)


def asked_phrases(queries: DataFrame, english: bool = False) -> DataFrame:
    """queries(query_id, query) -> (query_id, clause, n_phrases, phrase: array of words)."""
    terms = query_terms(queries)
    if english:
        terms = terms.filter(~F.col("term").isin(*sorted(STOP_WORDS))).withColumn("term", stem(F.col("term")))
    asked = terms.groupBy("query_id", "clause", "phrase").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "term"))), lambda x: x["term"]).alias("words")).select("query_id", "clause", F.col("words").alias("phrase")).distinct()
    needed = asked.groupBy("query_id", "clause").agg(F.count("*").alias("n_phrases")).withColumnsRenamed({"query_id": "_q", "clause": "_c"})
    return asked.join(needed, (F.col("query_id") == F.col("_q")) & (F.col("clause") == F.col("_c"))).drop("_q", "_c")


def scored(asked: DataFrame, found: DataFrame, k: int | None) -> DataFrame:
    """asked_phrases() and their hits(phrase, chunk_id, in_title, in_content) -> (query_id, chunk_id, rank_score, rank).

    With k, the best of a phrase are found once for all questions that ask for it alone, so that only k hits of each of
    these are joined, however many questions and chunks have the phrase.
    """
    value = TITLE_WEIGHT * F.log1p("in_title") + CONTENT_WEIGHT * F.log1p("in_content")
    found = found.select(F.col("phrase").alias("_phrase"), "chunk_id", value.alias("value"))
    if k is None:
        return _summed(asked, found)
    sizes = asked.groupBy(F.col("query_id").alias("_q")).agg(F.count("*").alias("_n"))
    sized = asked.join(sizes, F.col("query_id") == F.col("_q"))
    alone, others = sized.filter("_n = 1").select(asked.columns), sized.filter("_n > 1").select(asked.columns)
    ways = []
    if not alone.isEmpty():
        wanted = _few(alone.select(F.col("phrase").alias("_p")).distinct())
        hits = found.join(wanted, F.col("_phrase") == F.col("_p"), "left_semi").select("_phrase", "chunk_id", _score(F.col("value")).alias("rank_score"))
        hits = hits.withColumn("rank", F.row_number().over(W.partitionBy("_phrase").orderBy(F.desc("rank_score"), "chunk_id"))).filter(F.col("rank") <= k)
        ways.append(hits.join(_few(alone.select("query_id", "phrase")), F.col("phrase") == F.col("_phrase")).select("query_id", "chunk_id", "rank_score", "rank"))
    if not ways or not others.isEmpty():
        ways.append(_summed(others, found).filter(F.col("rank") <= k))
    return ways[0] if len(ways) == 1 else ways[0].unionByName(ways[1])


def _score(r: Column) -> Column:
    return F.round(r / (r + 1), 12)


def _summed(asked: DataFrame, found: DataFrame) -> DataFrame:
    """All hits of the questions, ranked; the phrases of an alternative must all be there."""
    hits = found.join(_few(asked), F.col("phrase") == F.col("_phrase"))
    clauses = hits.groupBy("query_id", "clause", "n_phrases", "chunk_id").agg(F.count("*").alias("n"), F.sum("value").alias("r")).filter("n = n_phrases")
    r = clauses.groupBy("query_id", "chunk_id").agg(F.sum("r").alias("r"))
    rows = r.select("query_id", "chunk_id", _score(F.col("r")).alias("rank_score"))
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("rank_score"), "chunk_id")))
