"""Byte-pair token counts against naive merging and a tokenizer library."""

import base64
import random

import pytest
from pyspark.sql import functions as F

from tomeloom.functions import bpe
from tomeloom.operators import chunking
from tomeloom.plans.store_queries import VOCABULARY


@pytest.fixture(scope="module")
def count():
    with open(VOCABULARY, "rb") as f:
        return bpe.Counter(f.read())


def naive(word, ranks):
    parts = [word[i : i + 1] for i in range(len(word))]
    while True:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not pairs:
            return len(parts)
        _, i = min(pairs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_heap_equals_naive_merging(count):
    rng = random.Random(5)
    for _ in range(10_000):
        word = "".join(rng.choice("aeinrstlohd' é中😀_0") for _ in range(rng.randint(0, 24))).encode()
        assert bpe.merged_length(word, count.ranks) == naive(word, count.ranks), word
    small = {b"a": 0, b"b": 1, b"aa": 2, b"ab": 3, b"aaa": 4, b"aab": 5, b"bab": 6, b"aabab": 7}
    for _ in range(2_000):
        word = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 14)))
        assert bpe.merged_length(word, small) == naive(word, small), word


def test_counts_equal_a_tokenizer_library(spark, sf, count):
    tiktoken = pytest.importorskip("tiktoken")
    with open(VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    whole = tiktoken.Encoding("own", pat_str=bpe.WORDS, mergeable_ranks=ranks, special_tokens={})
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(-1, None), (-2, ""), (-3, "  \n\n x<|endoftext|>"), (-4, "a" * 50_000)], "doc_id long, text string"))
    got = docs.select("text", bpe.token_count(F.col("text"), bpe.vocabulary(spark, VOCABULARY)).alias("n")).collect()
    assert len(got) > 100 and all(r.n == len(whole.encode_ordinary(r.text or "")) for r in got)


def test_long_words_take_little_time(count):
    import time

    began = time.time()
    assert count("ab" * 250_000) > 1
    assert time.time() - began < 20


def test_chunks_hold_their_limit_in_tokens(spark, sf, count):
    texts = ["", None, "one two. three\n\nfour " * 200, "x" * 3000, "中文😀" * 400, "\n" * 50]
    docs = spark.createDataFrame(list(enumerate(texts)), "document_id long, content string")
    docs = docs.union(spark.read.parquet(f"{sf}/documents.parquet").select((F.col("doc_id") + 10).alias("document_id"), F.col("text")))
    rows = chunking.token_chunks(docs, VOCABULARY, 40).collect()
    by = {}
    for r in sorted(rows, key=lambda r: r.chunk_index):
        assert r.token_count == count(r.content) and (r.token_count <= 40 or len(r.content) == 1)
        by.setdefault(r.document_id, []).append(r.content)
    blank = chunking.recursive_split
    for r in docs.collect():
        cut = chunking.token_split(r.content or "", 40, count)
        assert "".join(cut) == (r.content or "") and [p for p in cut if p.strip()] == by.get(str(r.document_id), [])
    assert blank("abc def", 4) == ["abc ", "def"]


def test_a_text_over_the_limit_is_not_read_to_its_end(count, monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(bpe, "WINDOW", 7)
    for _ in range(3_000):
        text = "".join(rng.choice(["a", "b", "é", "1", "'s", " ", "  ", "\n", ".", "中", "longword"]) for _ in range(rng.randint(0, 60)))
        n, limit = count(text), rng.randint(1, 40)
        assert count.up_to(text, limit) == n if n <= limit else count.up_to(text, limit) > limit
    took = []
    monkeypatch.setattr(bpe.Counter, "_sum", lambda self, words: took.append(sum(map(len, words))) or len(words))
    chunking.token_split("one two three four. " * 500, 500 * 5, count)
    assert count.up_to("one two " * 10_000, 20) > 20 and took[-1] < 200 and sum(took[-20:]) < 200


def test_words_asked_for_again_are_remembered(count, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    merged, real = [], bpe.merged_length
    monkeypatch.setattr(bpe, "merged_length", lambda word, ranks: merged.append(word) or real(word, ranks))
    fresh = bpe.Counter(b"")
    for i in range(1_000):
        assert fresh(f"often {'x' * (i % 7 + 1)}{i}") == 5 + 1 + i % 7 + 1 + len(str(i))
        assert len(fresh.seen) + len(fresh.older) <= 100
    assert merged.count(b"often") == 1


def test_large_vocabularies_are_refused(spark, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_VOCABULARY", 10)
    with pytest.raises(ValueError, match="above 10"):
        bpe.vocabulary(spark, VOCABULARY)
