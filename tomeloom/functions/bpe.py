"""Lengths of texts in byte-pair tokens of a given vocabulary."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator

import pandas as pd
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Bytes of a vocabulary file that are broadcast at most.
MAX_VOCABULARY = 64 << 20
#: Words whose lengths a worker notes before it keeps only those asked for again: twice as many are held at most.
REMEMBERED = 200_000
#: Bytes of a word up to which a list of its parts is quicker than a heap.
SHORT = 40
#: Characters that are cut into words at once where a text may be over a limit.
WINDOW = 1_000
# Fixed value: how byte-level vocabularies of this kind cut a text into words before they merge.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def read_ranks(content: bytes) -> dict[bytes, int]:
    """The tokens of a vocabulary file and their ranks; a line holds a token in base 64 and its rank."""
    pairs = (line.split() for line in content.splitlines() if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


def merged_length(word: bytes, ranks: dict[bytes, int]) -> int:
    """Number of tokens once neighbours are merged, the pair of least rank first, of equal ones the leftmost.

    Open merges wait in a heap; an entry whose parts have merged with others since is passed over. So a word of n
    bytes takes n log n, however long it is. Short words, nearly all, are merged in a list.
    """
    n = len(word)
    if n < 2 or word in ranks:
        return min(n, 1)
    if n <= SHORT:
        return _merged_short(word, ranks.get, n)
    # ends[i]: where the part that starts at i ends, 0 once it belongs to the one before; left[i]: start of the part before
    ends, left = list(range(1, n + 1)), list(range(-1, n))
    heap: list[tuple[int, int, int]] = []

    def offer(start: int) -> None:
        middle = ends[start]
        if middle < n:
            rank = ranks.get(word[start : ends[middle]])
            if rank is not None:
                heapq.heappush(heap, (rank, start, ends[middle]))

    for i in range(n - 1):
        offer(i)
    parts = n
    while heap:
        _, start, end = heapq.heappop(heap)
        middle = ends[start]
        if not middle or middle >= end or ends[middle] != end:
            continue
        ends[start], ends[middle] = end, 0
        if end < n:
            left[end] = start
            offer(start)
        if left[start] >= 0:
            offer(left[start])
        parts -= 1
    return parts


def _merged_short(word: bytes, rank_of: Callable[[bytes, int], int], n: int) -> int:
    cuts, none = list(range(n + 1)), 1 << 62
    # rank of each part's merge with the next one; the last has none
    ranks = [rank_of(word[i : i + 2], none) for i in range(n - 1)] + [none]
    while (least := min(ranks)) < none:
        i = ranks.index(least)
        del cuts[i + 1], ranks[i + 1]
        ranks[i] = rank_of(word[cuts[i] : cuts[i + 2]], none) if i + 2 < len(cuts) else none
        if i:
            ranks[i - 1] = rank_of(word[cuts[i - 1] : cuts[i + 1]], none)
    return len(ranks)


class Counter:
    """Counts the tokens of texts, from the bytes of a vocabulary. Words met again are remembered."""

    def __init__(self, content: bytes, pattern: str = WORDS):
        self.ranks, self.words, self.seen, self.older = read_ranks(content), regex.compile(pattern), {}, {}

    def __call__(self, text: str) -> int:
        return self._sum(self.words.findall(text))

    def _sum(self, words: list[str]) -> int:
        lengths = list(map(self.seen.get, words))
        total = sum(filter(None, lengths))
        if None in lengths:
            total += sum([self._length(word) for word, length in zip(words, lengths, strict=True) if length is None])
        return total

    def _length(self, word: str) -> int:
        seen = self.seen
        length = seen.get(word)
        if length is None:
            if len(seen) >= REMEMBERED:
                self.older, self.seen = seen, {}
            length = self.older.get(word)
            if length is None:
                length = merged_length(word.encode("utf-8", "surrogatepass"), self.ranks)
            if len(word) < 100:
                self.seen[word] = length
        return length

    def up_to(self, text: str, limit: int) -> int:
        """Number of tokens if it is at most the limit, else some number above it: a longer text is not read to its end.

        Words are found in windows; all but a window's last are what they are in the whole text, as WORDS leaves no
        character out and looks no further than the one after a word.
        """
        total, at, room = 0, 0, WINDOW
        while at < len(text) and total <= limit:
            end = min(at + room, len(text))
            words = self.words.findall(text, at, end)
            if end < len(text):
                end -= len(words.pop())
            if words:
                total, at = total + self._sum(words), end
            else:
                room *= 2
        return total


_counters: dict[bytes, Counter] = {}


def _counter(content: bytes) -> Counter:
    """The Counter of a vocabulary, kept by the worker from task to task."""
    key = hashlib.sha256(content).digest()
    if key not in _counters:
        _counters.clear()
        _counters[key] = Counter(content)
    return _counters[key]


def vocabulary(spark: SparkSession, path: str) -> Callable[[], Counter]:
    """What makes a Counter in a task. The file is read by Spark and broadcast; one above MAX_VOCABULARY is refused."""
    size, content = spark.read.format("binaryFile").load(path).select("length", F.when(F.col("length") <= MAX_VOCABULARY, F.col("content"))).first()
    if size > MAX_VOCABULARY:
        raise ValueError(f"vocabulary of {size} bytes: above {MAX_VOCABULARY}")
    held = spark.sparkContext.broadcast(bytes(content))
    return lambda: _counter(held.value)


def token_count(text: Column, counter: Callable[[], Counter]) -> Column:
    """Number of tokens of a text as a long; null counts as empty."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = counter()
        for texts in batches:
            yield texts.map(count).astype("int64")

    return F.pandas_udf(run, "long")(F.coalesce(text, F.lit("")))
