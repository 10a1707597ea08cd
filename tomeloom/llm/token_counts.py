"""Token counts by a linear longest-match automaton (operator 7).

The vocabulary is a trie with two roots, one for pieces that begin a word and one for pieces that go on.
Every node has a failure link to the node where matching resumes once the longest pieces of what has been
read are popped, and the number of pieces popped on the way. Following them, a word is read once, in time
proportional to its length, and its greedy longest-match pieces are counted but never built.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_WORD, fresh, table

#: Fixed value: the mark of pieces that begin a word.
MARK = "▁"
VOCABULARY = "piece_bpe_32k.model"
#: Words whose counts a Python worker remembers.
MEMORY = 400_000

split_words = re.compile(SPACE_WORD).findall


def pieces_of(path: str) -> list[str]:
    """The text pieces of a sentencepiece vocabulary file: no control, unknown or byte pieces. Read on the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


class Automaton:
    """Counts pieces of greedy longest matching. Node 0 begins a word, node 1 goes on."""

    def __init__(self, pieces: Iterable[str], mark: str = MARK):
        pieces = sorted(set(pieces))
        self.name = xxhash.xxh3_128_hexdigest("\0".join([mark, *pieces]))
        nexts: list[dict[str, int]] = [{}, {}]
        ends = {}
        for piece in pieces:
            at, rest = (0, piece[len(mark) :]) if piece.startswith(mark) else (1, piece)
            for c in rest:
                if c not in nexts[at]:
                    nexts[at][c] = len(nexts)
                    nexts.append({})
                at = nexts[at][c]
            if at != 1:
                ends[at] = True
        self.nexts = nexts
        # where a failure leads (-1: nowhere) and how many pieces it pops
        self.fails, self.pops = [-1] * len(nexts), [0] * len(nexts)
        if 0 in ends:
            self.fails[0], self.pops[0] = 1, 1
        todo = deque([0, 1])
        while todo:
            u = todo.popleft()
            for c, v in nexts[u].items():
                todo.append(v)
                if v in ends:
                    self.fails[v], self.pops[v] = 1, 1
                    continue
                popped, z = self.pops[u], self.fails[u]
                while z != -1 and c not in nexts[z]:
                    popped, z = popped + self.pops[z], self.fails[z]
                if z != -1:
                    self.fails[v], self.pops[v] = nexts[z][c], popped

    def count(self, word: str) -> int:
        """Pieces of the word, or 0 if greedy matching fails: such a word is one unknown token."""
        nexts, fails, pops = self.nexts, self.fails, self.pops
        at, n = 0, 0
        for c in word:
            while (to := nexts[at].get(c)) is None:
                if fails[at] == -1:
                    return 0
                n += pops[at]
                at = fails[at]
            at = to
        while at != 1:
            if fails[at] == -1:
                return 0
            n += pops[at]
            at = fails[at]
        return n


class _Remembered(dict):
    def __init__(self, automaton: Automaton):
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMORY:
            self.clear()
        n = self[word] = self.automaton.count(word)
        return n


_remembered: dict[str, _Remembered] = {}


def token_counts(documents: DataFrame, pieces: list[str], text_col: str = "text") -> DataFrame:
    """documents with n_words, n_tokens and n_unknown (words that are one unknown token) added or replaced.

    Words are runs without white space, unchanged. The vocabulary's size is fixed by its file, so its
    automaton is broadcast. Null and empty texts have no tokens; texts are read whole, of any length. Rows are
    counted one by one: repeated rows stay repeated, equal texts count alike, and an empty table gives an empty
    result. Other columns are kept, whatever their names.
    """
    shared = documents.sparkSession.sparkContext.broadcast(Automaton(pieces))

    @F.pandas_udf("n_words long, n_tokens long, n_unknown long")
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = shared.value
        if automaton.name not in _remembered:
            _remembered.clear()
            _remembered[automaton.name] = _Remembered(automaton)
        memory = _remembered[automaton.name]
        for batch in batches:
            rows = np.zeros((len(batch), 3), np.int64)
            for i, text in enumerate(batch):
                found = list(map(memory.__getitem__, split_words(text)))
                unknown = found.count(0)
                rows[i] = len(found), sum(found) + unknown, unknown
            yield pd.DataFrame(rows, columns=["n_words", "n_tokens", "n_unknown"])

    held = fresh(documents, "_counts")
    out = documents.withColumn(held, counts(F.coalesce(F.col(text_col), F.lit(""))))
    return out.withColumns({c: F.col(f"{held}.{c}") for c in ("n_words", "n_tokens", "n_unknown")}).drop(held)


def op7_token_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, pieces_of(default_path())).select("doc_id", "n_words", "n_tokens", "n_unknown")
