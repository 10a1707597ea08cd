"""Scoring texts with a causal self-attention model trained in numpy on subword ids (operator 4).

A position of the model is a token: a word, which is the mean of the rows of its subword ids, or the end.
Texts are cut into blocks of BLOCK positions. A block attends to itself, masked causally, and to the block
before it, so windows overlap and every token is scored once. What attention gathers weighs COMPONENTS
distributions of the id that begins the next token. The corpus' WHOLE most frequent words have an id of
their own each, so that attention decides them wholly; of all others it decides the first subword id, and how
the word goes on is left to the counts of the whole corpus:

  P(word | context) = sum over k of pi_k(context) * theta_k(first id)  *  P(word | first id)

P(word | first id) takes a discount off every known word of that first id and gives it to the spellings of
all words, by counts of which subword id follows which. All chances sum to at most 1.

Training is where the texts are. Each task takes steps on all blocks of all its training texts: attention by
its gradient, theta by the expected counts that each step adds. Tasks' parameters are averaged by evidence
and their expected counts summed, in two levels, after each round. Word counts, spelling counts and the
number of steps grow with the corpus; what is sent around has the size of the model.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain, repeat
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, table

VOCABULARY = "piece_bpe_32k.model"
#: Numbers of a query or key, and distributions that attention weighs.
WIDTH, COMPONENTS = 8, 8
BLOCK = 16
#: Most frequent words that have an id of their own, if they are seen so often in training.
WHOLE, WHOLE_LEAST = 8192, 50
#: Blocks of a training step, and blocks scored at once.
STEP = 256
#: Bytes of the texts that are looked up together: bounds a task's memory besides its longest text.
LOT = 1 << 20
#: Words and counts that a task holds before it sums them, and those handed on at once.
COUNTED, HANDED = 1 << 19, 50_000
#: Passes over all training texts.
ROUNDS = 1
RATE = 0.1
#: Weight of the first distributions in tokens, and of what a word's subword ids say about them before training.
SEED_WEIGHT, SEED_SLOPE = 4000.0, 4.0
#: Words whose counts are broadcast: the most frequent ones. The counts of all others are joined.
HEAD_WORDS = 400_000
#: Followers of subword ids that are told apart: the most frequent ones. All others share what is left by their own counts.
PAIRS = 500_000
#: Words that a Python worker remembers; when they are more, those seen in most lots stay, KEPT of them.
MEMORY, KEPT = 400_000, 250_000
#: Groups that tasks' parameters are summed in before they meet, and rows of a message.
LOTS, PART = 32, 128
BEGIN, END = 1, 2
Q, K, V = slice(0, WIDTH), slice(WIDTH, 2 * WIDTH), slice(2 * WIDTH, 2 * WIDTH + COMPONENTS)


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a text given in UTF-8, A-Z lower-cased: bytes are lowered and split by these rules."""
    return text.lower().split() if text else []


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def laid_end_to_end(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[i], ..., start[i] + length[i] - 1 for each i."""
    return np.repeat(start - (np.cumsum(length) - length), length) + np.arange(length.sum())


class Rows:
    """An array that grows at its end."""

    def __init__(self, first: np.ndarray):
        self.held, self.n = first, len(first)

    def add(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.held):
            held = np.empty((2 * (self.n + len(more)), *self.held.shape[1:]), self.held.dtype)
            held[: self.n] = self.held[: self.n]
            self.held = held
        self.held[self.n : self.n + len(more)] = more
        self.n += len(more)

    def all(self) -> np.ndarray:
        return self.held[: self.n]


class Vocabulary(NamedTuple):
    """A public vocabulary of subwords, and words of the corpus that are no longer parted."""

    pieces: bytes
    whole: tuple[str, ...] = ()


class Parts:
    """Subword ids; after them one id for each whole word."""

    def __init__(self, vocabulary: Vocabulary):
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=vocabulary.pieces)
        self.whole = {w: [i] for i, w in enumerate(vocabulary.whole, self.pieces.vocab_size())}

    def vocab_size(self) -> int:
        return self.pieces.vocab_size() + len(self.whole)

    def encode(self, words: str | list[str], num_threads: int = 1) -> list:
        if isinstance(words, str):
            return self.encode([words])[0]
        found = list(map(self.whole.get, words))
        parted = [i for i, x in enumerate(found) if x is None]
        for i, x in zip(parted, self.pieces.encode([words[i] for i in parted], num_threads=num_threads), strict=True):
            found[i] = x
        return found


class Words:
    """Distinct words of a worker: their subword ids, laid end to end. Entries 0 and 1 are begin and end."""

    #: Of the growing arrays, those that have a row for each id; the others have one for each word.
    OF_IDS = frozenset(["ids"])

    def __init__(self, proto: Vocabulary | bytes):
        self.model = Parts(proto if isinstance(proto, Vocabulary) else Vocabulary(proto))
        self._clear()

    def _clear(self) -> None:
        self.at: dict[bytes, int] = {}
        self.ids, self.start, self.length = Rows(np.array([BEGIN, END], np.int32)), Rows(np.array([0, 1])), Rows(np.array([1, 1]))
        self.seen = Rows(np.zeros(2, np.int32))

    def _encoded(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, end to end, and their numbers."""
        try:
            named = b"\n".join(new).decode().split("\n") if new else []  # no word has a line end
        except UnicodeDecodeError:
            named = [w.decode("utf-8", "replace") for w in new]
        found = [x or [0] for x in self.model.encode(named, num_threads=1)]
        length = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int32, int(length.sum())), length

    def _add(self, new: list[bytes], ids: np.ndarray, length: np.ndarray) -> None:
        self.at.update(zip(new, range(self.start.n, self.start.n + len(new)), strict=True))
        self.start.add(self.ids.n + np.cumsum(length) - length)
        self.length.add(length)
        self.ids.add(ids)
        self.seen.add(np.zeros(len(new), np.int32))

    def _forget(self, n: int) -> None:
        """All but the n words that most calls asked for."""
        words = list(self.at)
        stay = np.sort(np.argsort(-self.seen.all()[2:], kind="stable")[:n])
        self.at = dict(zip(map(words.__getitem__, stay.tolist()), range(2, len(stay) + 2), strict=True))
        stay = np.append([0, 1], stay + 2)
        ids = laid_end_to_end(self.start.all()[stay], self.length.all()[stay])
        # what is known of the words that stay is kept as it is
        for name, held in [(name, x) for name, x in vars(self).items() if isinstance(x, Rows)]:
            setattr(self, name, Rows(held.all()[ids if name in self.OF_IDS else stay]))
        length = self.length.all()
        self.start.all()[:] = np.cumsum(length) - length
        self.seen.all()[:] //= 2

    def of(self, words: list[bytes]) -> np.ndarray:
        """Entry of each word; entries hold until the next call."""
        at = np.fromiter(map(self.at.get, words, repeat(-1)), np.int32, len(words))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = list(dict.fromkeys(map(words.__getitem__, missing.tolist())))
            if len(self.at) and len(self.at) + len(new) > MEMORY:
                self._forget(min(KEPT, len(self.at), max(0, MEMORY - len(words))))
                at = np.fromiter(map(self.at.get, words, repeat(-1)), np.int32, len(words))
                missing = np.flatnonzero(at < 0)
                new = list(dict.fromkeys(map(words.__getitem__, missing.tolist())))
            begin = self.start.n
            self._add(new, *self._encoded(new))
            if len(new) == len(missing):
                at[missing] = np.arange(begin, begin + len(new))
            else:
                at[missing] = np.fromiter(map(self.at.__getitem__, map(words.__getitem__, missing.tolist())), np.int32, len(missing))
        self.seen.all()[at] += 1
        return at


class Trained(Words):
    """Words with the table rows of their ids and their rows of theta."""

    OF_IDS = frozenset(["ids", "rows"])

    def __init__(self, proto: Vocabulary, row_of: np.ndarray, first_of: np.ndarray):
        self.row_of, self.first_of = row_of, first_of
        super().__init__(proto)

    def _clear(self) -> None:
        super()._clear()
        self.rows, self.firsts = Rows(self.row_of[[BEGIN, END]]), Rows(self.first_of[[BEGIN, END]])

    def _add(self, new: list[bytes], ids: np.ndarray, length: np.ndarray) -> None:
        super()._add(new, ids, length)
        self.rows.add(self.row_of[ids])
        self.firsts.add(self.first_of[ids[np.cumsum(length) - length]])


def laid_out(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of inputs and targets of several texts' entries, and whether a block begins a text. Missing targets are -1."""
    sizes = np.array([len(x) + 1 for x in texts], np.int64)
    blocks = -(-sizes // BLOCK)
    begin = np.cumsum(blocks) - blocks
    inputs, targets = np.zeros(int(blocks.sum()) * BLOCK, np.int32), np.full(int(blocks.sum()) * BLOCK, -1, np.int32)
    for x, b in zip(texts, (begin * BLOCK).tolist(), strict=True):
        inputs[b + 1 : b + 1 + len(x)] = x  # the first is begin
        targets[b : b + len(x)] = x
        targets[b + len(x)] = 1
    first = np.zeros(int(blocks.sum()), bool)
    first[begin] = True
    return inputs.reshape(-1, BLOCK), targets.reshape(-1, BLOCK), first


def steps_of(inputs: np.ndarray, targets: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """STEP blocks at a time. Each block is a target once; where a step parts a text, the block before goes along without targets."""
    for i in range(0, len(inputs), STEP):
        lead = int(not first[i])
        part = slice(i - lead, i + STEP)
        wanted, begins = targets[part].copy(), first[part].copy()
        wanted[:lead] = -1
        begins[0] = True
        yield inputs[part], wanted, begins


_distance = np.arange(BLOCK)[:, None] + BLOCK - np.arange(2 * BLOCK)[None, :]
_causal = _distance >= 0
_distance = np.clip(_distance, 0, 2 * BLOCK - 1)


def word_rows(table: np.ndarray, rows: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Mean of the table's rows of each word; a word's own are rows[start : start + length]. Quickest for words in order of length."""
    if len(length) and (length[1:] < length[:-1]).any():
        order = np.argsort(length, kind="stable")
        out = np.empty((len(length), table.shape[1]), table.dtype)
        out[order] = word_rows(table, rows, start[order], length[order])
        return out
    out = table.take(rows[start], 0)
    for j in range(1, int(length[-1]) if len(length) else 0):
        longer = int(np.searchsorted(length, j, "right"))
        out[longer:] += table.take(rows[start[longer:] + j], 0)
    out /= length[:, None].astype(np.float32)
    return out


def _with_before(x: np.ndarray, first: np.ndarray, ones: int = 0) -> np.ndarray:
    """Each block after the one before it, none where a text begins; ones: columns of ones after the others."""
    out = np.empty((len(x), 2 * BLOCK, x.shape[2] + ones), np.float32)
    columns = slice(0, x.shape[2])
    out[:, BLOCK:, columns] = x
    out[1:, :BLOCK, columns] = x[:-1]
    out[first, :BLOCK] = 0
    out[:, :, x.shape[2] :] = 1
    return out


def _turned(x: np.ndarray) -> np.ndarray:
    """The matrices of x transposed, laid out anew: products of small matrices are quicker so."""
    return np.ascontiguousarray(x.transpose(0, 2, 1))


def _sums(x: np.ndarray) -> np.ndarray:
    """Sums over the last axis, which stays; quicker than sum() where it is short."""
    return np.matmul(x, np.ones((x.shape[-1], 1), x.dtype))


def attend(p: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray):
    """Masked attention of blocks x: (weights of components, weights of keys before they are divided, their sums,
    what they gather, q, k, v and a column of ones)."""
    q, k, v = np.ascontiguousarray(x[:, :, Q]), _with_before(x[:, :, K], first), _with_before(x[:, :, V], first, 1)
    weight = np.matmul(q, _turned(k))
    weight += np.where(_causal, p["r"][_distance, 0], np.float32(-1e9))
    weight[first, :, :BLOCK] = -1e9
    if weight.max() > 60:
        np.minimum(weight, np.float32(60), out=weight)
    np.exp(weight, out=weight)
    gathered = np.matmul(weight, v)
    total = np.ascontiguousarray(gathered[:, :, COMPONENTS:])
    gathered = gathered[:, :, :COMPONENTS] / total
    z = gathered + p["a"][:, 0]
    np.exp(np.clip(z, -60, 60, out=z), out=z)
    z /= _sums(z)
    return z, weight, total, gathered, q, k, v


def first_chances(p: dict[str, np.ndarray], theta: np.ndarray, x: np.ndarray, targets: np.ndarray, first: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Natural log chance of the id that begins each target, in order; firsts gives each entry's row of theta."""
    real = targets.ravel() >= 0
    pi = attend(p, x, first)[0].reshape(-1, COMPONENTS)
    return np.log((pi[real] * theta.take(firsts[targets.ravel()[real]], 0)).sum(1).astype(np.float64))


def _by_row(rows: np.ndarray, columns: np.ndarray, n: int) -> np.ndarray:
    """Sums of the values of each row; columns[j] has the j-th value of each of the rows."""
    out = np.empty((len(columns), n))
    for to, values in zip(out, columns, strict=True):
        to[:] = np.bincount(rows, values, n)
    return out


def _columns(x: np.ndarray) -> np.ndarray:
    """The last axis of x first, the others as one."""
    return x.reshape(-1, x.shape[-1]).T


def _told_apart(at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers, and for each number its place among them: np.unique() without a sort, for numbers below a small n."""
    some = np.zeros(n, bool)
    some[at] = True
    distinct = np.flatnonzero(some)
    place = np.empty(n, np.int64)
    place[distinct] = np.arange(len(distinct))
    return distinct, place.take(at)


def train_step(p: dict[str, np.ndarray], squares: dict[str, np.ndarray], expected: np.ndarray, rows: np.ndarray, start: np.ndarray, length: np.ndarray, firsts: np.ndarray, inputs: np.ndarray, targets: np.ndarray, first: np.ndarray) -> None:
    """One Adagrad step of attention on some blocks, and what they add to the expected counts of theta.

    rows, start and length lay out the table rows of each entry, firsts its row of theta. Each word of the step
    is put together once, and only rows that it has are changed: no others have a gradient.
    """
    distinct, place = _told_apart(inputs.ravel(), len(length))
    start, length = start[distinct], length[distinct]
    x = word_rows(p["e"], rows, start, length).take(place, 0).reshape(*inputs.shape, -1)
    pi, weight, total, gathered, q, k, v = attend(p, x, first)
    wanted = firsts[np.maximum(targets, 0).ravel()]
    mine = expected.take(wanted, 0).reshape(pi.shape)
    mine *= pi / (np.ones(len(expected), np.float32) @ expected)
    mine /= _sums(mine)
    real = (targets >= 0)[:, :, None].astype(np.float32)
    mine *= real
    back = mine - pi * real
    hit, wanted = _told_apart(wanted, len(expected))
    expected[hit] += _by_row(wanted, _columns(mine), len(hit)).T
    bias = (np.ones(targets.size, np.float32) @ back.reshape(-1, COMPONENTS))[:, None]
    back /= total
    # a key's slope is its weight times (what its v would add, less what all v add): the ones beside v carry the latter
    wide = np.concatenate([back, -_sums(back * gathered)], 2)
    slope = np.matmul(wide, _turned(v))
    slope *= weight
    grad = np.empty((x.shape[2], inputs.size))
    grad[Q] = _columns(np.matmul(slope, k))
    follows = (~first[1:]).astype(np.float32)[:, None, None]
    for columns, y in ((K, np.matmul(slope.transpose(0, 2, 1), q)), (V, np.matmul(weight.transpose(0, 2, 1), back))):
        own = y[:, BLOCK:]
        own[:-1] += y[1:, :BLOCK] * follows
        grad[columns] = _columns(own)
    grad = _by_row(place, grad, len(distinct)) / length
    moved, at = _told_apart(rows[laid_end_to_end(start, length)], len(p["e"]))
    by_distance = np.bincount(_distance.ravel(), np.ones(len(slope), np.float32) @ slope.reshape(len(slope), -1), 2 * BLOCK)[:, None].astype(np.float32)
    change = _by_row(at, np.repeat(grad, length, 1), len(moved)).T.astype(np.float32, order="C")
    for name, which, change in (("e", moved, change), ("r", slice(None), by_distance), ("a", slice(None), bias)):
        sums = squares[name][which]
        sums += change * change
        squares[name][which] = sums
        change *= RATE
        change /= np.sqrt(sums) + np.float32(1e-3)
        p[name][which] += change


class Lot(NamedTuple):
    """Some rows; the words of their texts, in order, are words[code]; counts has how many each text has."""

    rows: pd.DataFrame
    words: list[bytes]
    code: np.ndarray
    counts: np.ndarray


def _lots(batches: Iterator[pd.DataFrame]) -> Iterator[Lot]:
    """Some rows at a time, LOT bytes or one text, split into words as words_of does it."""
    for batch in batches:
        begin, texts = 0, batch["text"].tolist()
        for end in _ends(np.array([len(t or b"") for t in texts])):
            yield _lot(batch.iloc[begin:end], texts[begin:end])
            begin = end


def _lot(rows: pd.DataFrame, texts: list[bytes | None]) -> Lot:
    words, counts = _split(pa.array([t or b"" for t in texts], pa.binary()))
    return Lot(rows, words.dictionary.to_numpy(zero_copy_only=False).tolist(), words.indices.to_numpy(), counts)


def _split(texts: pa.BinaryArray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Words of all texts, none of them null, in order, and how many each text has."""
    # bytes seen as a string: these functions look at ASCII only, whatever the other bytes are
    trimmed = pc.ascii_trim_whitespace(pc.ascii_lower(texts.view(pa.string())))
    lists = pc.ascii_split_whitespace(trimmed)
    some = pc.binary_length(trimmed).to_numpy() > 0  # an empty text is split into one empty word
    counts = np.where(some, pc.list_value_length(lists).to_numpy(), 0)
    words = lists.flatten() if some.all() else lists.filter(pa.array(some)).flatten()
    return words.view(pa.binary()).dictionary_encode(), counts


def _laid_lot(words: Words, lot: Lot) -> tuple[np.ndarray, list[np.ndarray]]:
    """The lot's own entries, begin and end first, then its words by length, as entries of words; and its texts in them."""
    at = words.of(lot.words)
    order = np.argsort(np.minimum(words.length.all()[at], 1 << 15).astype(np.uint16), kind="stable")
    place = np.empty(len(at), np.int32)
    place[order] = np.arange(2, len(at) + 2)
    return np.append(np.array([0, 1], np.int32), at[order]), np.split(place[lot.code], np.cumsum(lot.counts)[:-1])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and their counts; the empty word stands for the ends."""
    held, size = [], 0
    for batch in batches:
        texts = pc.fill_null(batch.column("text").cast(pa.binary()), b"")
        begin = 0
        for end in _ends(pc.binary_length(texts).to_numpy()):
            words, _ = _split(texts.slice(begin, end - begin))
            named = pa.concat_arrays([words.dictionary, pa.array([b""], pa.binary())])
            held.append(pa.table({"w": named, "c": np.append(np.bincount(words.indices, minlength=len(words.dictionary)), end - begin)}))
            begin, size = end, size + len(named)
            if size > COUNTED:
                held = [_summed(held)]
                size = len(held[0])
                if size > COUNTED // 2:
                    yield from held[0].to_batches(HANDED)
                    held, size = [], 0
    if held:
        yield from _summed(held).to_batches(HANDED)


def _ends(sizes: np.ndarray) -> Iterator[int]:
    """Where lots end: LOT bytes or one text each."""
    size = 0
    for i, n in enumerate(sizes.tolist(), 1):
        size += n
        if size >= LOT or i == len(sizes):
            yield i
            size = 0


def _summed(counts: list[pa.Table]) -> pa.Table:
    out = pa.concat_tables(counts).group_by("w", use_threads=False).aggregate([("c", "sum")])
    return pa.table({"w": out["w"], "c": out["c_sum"]}).combine_chunks()


def _count_ids(proto: Vocabulary):
    """Of words and counts: (a, b, n, kinds): ids that begin words (b = -1) with their words' counts and number of
    words, and ids that follow others, END for none, with the number of words that have them so."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, size = Words(proto), 0
        size = words.model.vocab_size()
        begins, pairs = np.zeros((size, 2), np.int64), Counter()
        for batch in batches:
            for i in range(0, len(batch), 50_000):
                part = batch.iloc[i : i + 50_000]
                part = part[part["w"].str.len() > 0]
                at = words.of(part["w"].tolist())
                start, count, every = words.start.all()[at], words.length.all()[at], words.ids.all()
                first = every[start]
                begins += np.stack([np.bincount(first, part["c"].to_numpy(), size), np.bincount(first, minlength=size)], 1).astype(np.int64)
                ids = every[laid_end_to_end(start, count)].astype(np.int64)
                following = np.append(ids[1:], END)
                following[np.cumsum(count) - 1] = END
                keys, n = np.unique(ids * size + following, return_counts=True)
                for key, m in zip(keys.tolist(), n.tolist(), strict=True):
                    pairs[key] += m
        keys = np.fromiter(pairs, np.int64, len(pairs))
        yield pd.DataFrame({"a": keys // size, "b": keys % size, "n": np.fromiter(pairs.values(), np.int64, len(pairs)), "kinds": 0})
        used = np.flatnonzero(begins[:, 1])
        yield pd.DataFrame({"a": used, "b": -1, "n": begins[used, 0], "kinds": begins[used, 1]})

    return run


class Spelling:
    """Chances of the subword id that follows another inside a word, or of the word's end after it."""

    OFF = 0.5

    def __init__(self, size: int, pairs: pd.DataFrame, out: np.ndarray, into: np.ndarray):
        """pairs(a, b, n): the followers told apart; out and into: how often each id is followed, and follows, in all."""
        self.size = size
        key = pairs["a"].to_numpy(np.int64) * size + pairs["b"].to_numpy(np.int64)
        order = np.argsort(key)
        self.key, self.n = key[order], pairs["n"].to_numpy(float)[order] - self.OFF
        self.out = out.astype(float)
        self.rest = np.maximum(self.out - np.bincount(self.key // size, self.n, size), 0)
        self.into = (into + 0.5) / (into.sum() + 0.5 * size)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Natural log chances."""
        wanted = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.key, wanted), max(len(self.key) - 1, 0))
        n = np.where(self.key[at] == wanted, self.n[at], 0.0) if len(self.key) else np.zeros(len(wanted))
        out = self.out[a]
        return np.log(np.where(out > 0, (n + self.rest[a] * self.into[b]) / np.maximum(out, 1), self.into[b]))

    def words(self, ids: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Natural log chance of each word after its first id; ids are laid end to end."""
        following = np.append(ids[1:], END)
        ends = np.cumsum(length) - 1
        following[ends] = END
        return np.add.reduceat(self.of(ids, following), ends - length + 1) if len(length) else np.zeros(0)


class Model:
    """What scoring needs; its size is bounded by the vocabulary, HEAD_WORDS and PAIRS.

    row_of, first_of: of each id its row of the table of rows, and its row of theta; 0 for ids not seen.
    """

    def __init__(self, proto, row_of, first_of, parameters, expected, spelling, begins, kinds, discount, head, ends, total, vocabulary):
        self.proto, self.row_of, self.first_of, self.parameters, self.expected = proto, row_of, first_of, parameters, expected
        self.spelling, self.begins, self.kinds, self.discount = spelling, begins, kinds, discount
        self.head, self.ends, self.total, self.vocabulary = head, ends, total, vocabulary
        self.name = xxhash.xxh3_128_hexdigest(b"".join(x.tobytes() for x in (*parameters.values(), expected)) + repr((total, vocabulary, len(head))).encode())

    def theta(self) -> np.ndarray:
        return (self.expected / self.expected.sum(0)).astype(np.float32)


def components(size: int, pairs: pd.DataFrame, n: int = COMPONENTS) -> np.ndarray:
    """For each id its shares of the first distributions: ids that stand in the same words share one.

    The leading directions of the graph of followers, by orthogonal iteration, grouped by their angles.
    """
    draw = np.random.default_rng(7)
    shares = np.full((size, n), 1 / n)
    pairs = pairs[pairs["b"] != END]
    if not len(pairs):
        return shares
    a, b, weight = pairs["a"].to_numpy(), pairs["b"].to_numpy(), np.log1p(pairs["n"].to_numpy(float))
    a, b, weight = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([weight, weight])
    order = np.argsort(a, kind="stable")
    a, b, weight = a[order], b[order], weight[order]
    degree = np.bincount(a, weight, size)
    weight = weight / np.sqrt(degree[a] * degree[b])
    begin = np.flatnonzero(np.diff(a, prepend=-1))
    used = a[begin]
    x = draw.normal(size=(size, n))
    for _ in range(30):
        y = 0.5 * x
        y[used] += np.add.reduceat(weight[:, None] * x[b], begin)
        x = np.linalg.qr(y)[0]
    x = x[used] / np.sqrt(degree[used])[:, None]
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    degree = degree[used]
    centres = x[np.argmax(degree)][None]
    for _ in range(n - 1):
        far = np.min(((x[:, None] - centres[None]) ** 2).sum(2), 1) * degree
        centres = np.concatenate([centres, x[np.argmax(far)][None]])
    for _ in range(20):
        label = np.argmax(x @ centres.T, 1)
        sums = np.stack([np.bincount(label, x[:, j] * degree, n) for j in range(x.shape[1])], 1)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.maximum(norm, 1e-12), centres)
    shares[used] = 0.3 / n
    shares[used, label] += 0.7
    return shares


def first_parameters(row_of: np.ndarray, firsts: np.ndarray, begins: np.ndarray, shares: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Parameters and expected counts before training; begins: counts of the ids that begin tokens, which are firsts."""
    draw = np.random.default_rng(11)
    counts = np.append(0.5, begins[firsts] + 0.5)
    mine = np.concatenate([np.full((1, COMPONENTS), 1 / COMPONENTS), shares[firsts]])
    expected = (counts[:, None] / counts.sum() * SEED_WEIGHT * mine + 1e-3).astype(np.float32)
    weight = expected.sum(0) / expected.sum()
    rows = np.zeros((int(row_of.max(initial=0)) + 1, 2 * WIDTH + COMPONENTS), np.float32)
    used = np.flatnonzero(row_of)
    rows[:, : 2 * WIDTH] = draw.normal(0, 0.3, (len(rows), 2 * WIDTH))
    rows[row_of[used], 2 * WIDTH :] = SEED_SLOPE * np.log((shares[used] + 0.05) / (weight + 0.05))
    return {"e": rows, "r": np.zeros((2 * BLOCK, 1), np.float32), "a": np.log(weight)[:, None].astype(np.float32)}, expected


_held: dict[str, Words] = {}


def _remembered(name: str, make: Callable[[], Words]) -> Words:
    """What this Python worker holds from its last task of that name."""
    if name not in _held:
        _held.clear()
        _held[name] = make()
    return _held[name]


def _train(shared, proto: Vocabulary):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        row_of, first_of, start, seeds = shared.value
        p, expected = {x: y.copy() for x, y in start.items()}, seeds.copy()
        squares = {x: np.full(y.shape, 1e-2, np.float32) for x, y in p.items()}
        name = "train" + xxhash.xxh3_128_hexdigest(repr(proto).encode() + row_of.tobytes() + first_of.tobytes())
        words, some = _remembered(name, lambda: Trained(proto, row_of, first_of)), False
        for lot in _lots(batches):
            at, entries = _laid_lot(words, lot)
            blocks = laid_out(entries)
            laid = [words.rows.all(), *(x.all()[at] for x in (words.start, words.length, words.firsts))]
            for inputs, targets, first in steps_of(*blocks):
                train_step(p, squares, expected, *laid, inputs, targets, first)
                some = True
        if some:
            lot = TaskContext.get().partitionId() % LOTS
            for name, values in p.items():
                weight = np.sqrt(squares[name] - 1e-2 + 1e-12)  # a row's change counts by the evidence for it
                yield from _messages(name, lot, (values - start[name]) * weight, weight)
            yield from _messages("theta", lot, expected - seeds, np.zeros((len(expected), 0)))

    return run


def _messages(name: str, lot: int, change: np.ndarray, weight: np.ndarray) -> Iterator[pd.DataFrame]:
    for i in range(0, len(change), PART):
        if change[i : i + PART].any():
            yield pd.DataFrame({"name": [name], "part": [i], "lot": [lot], "change": [change[i : i + PART].astype(np.float32).tobytes()], "weight": [weight[i : i + PART].astype(np.float32).tobytes()]})


def _added(group: pd.DataFrame) -> pd.DataFrame:
    out = group.iloc[:1].copy()
    for name in ("change", "weight"):
        total = np.zeros(len(group[name].iloc[0]) // 4)
        for x in group[name]:
            total += np.frombuffer(x, np.float32)
        out[name] = [total.astype(np.float32).tobytes()]
    return out


MESSAGE = "name string, part int, lot int, change binary, weight binary"


def fit(texts: DataFrame, path: str | None = None, head_words: int = HEAD_WORDS, rounds: int = ROUNDS, pairs: int = PAIRS, whole: int = WHOLE) -> tuple[Model, DataFrame]:
    """texts(text binary) -> the model, and the counts (w, c) of the words beyond its head, as a written table."""
    import sentencepiece

    spark = texts.sparkSession
    pieces = sentencepiece.SentencePieceProcessor(model_file=path or default_path())
    counts = stored(texts.mapInArrow(_count_words, "w binary, c long").groupBy("w").agg(F.sum("c").alias("c")))
    is_end = F.octet_length("w") == 0
    about = counts.agg(
        *[F.coalesce(x, F.lit(0)) for x in (F.sum(F.when(is_end, F.col("c"))), F.sum(F.when(~is_end, F.col("c"))), F.count_if(~is_end), F.count_if(~is_end & (F.col("c") == 1)), F.count_if(~is_end & (F.col("c") == 2)))]
    ).first()
    ends, total, distinct, ones, twos = map(int, about)
    discount = min(0.9, max(0.1, ones / max(1, ones + 2 * twos)))
    # the least count whose words fit into the head: from the number of words by count
    sizes = counts.groupBy(F.least("c", F.lit(1000)).alias("c")).count().orderBy(F.desc("c")).collect()
    least, held = 1001, 0
    for r in sizes:
        if (held := held + r["count"]) > head_words:
            break
        least = r.c
    if least > 1000 and sizes:  # more very frequent words than the head holds
        least = counts.orderBy(F.desc("c")).limit(head_words).agg(F.min("c")).first()[0] + 1
    head = counts.filter((F.col("c") >= least) & ~is_end).toPandas()
    tail = counts.filter((F.col("c") < least) & ~is_end)

    often = counts.filter(~is_end & (F.col("c") >= WHOLE_LEAST)).orderBy(F.desc("c"), "w").limit(whole).select("w").toPandas()["w"]
    # malformed words have subword ids only, as they are decoded with marks that others may hold
    proto = Vocabulary(pieces.serialized_model_proto(), tuple(t for t in (bytes(w).decode("utf-8", "replace") for w in often) if "\ufffd" not in t))
    size = pieces.vocab_size() + len(proto.whole)
    followers = stored(counts.mapInPandas(_count_ids(proto), "a long, b long, n long, kinds long").groupBy("a", "b").agg(F.sum("n").alias("n"), F.sum("kinds").alias("kinds")))
    by_id = lambda df, key: df.groupBy(F.col(key).alias("id")).agg(F.sum("n").alias("n"), F.sum("kinds").alias("kinds")).toPandas()
    inside = followers.filter("b >= 0")
    dense = lambda frame, name: np.bincount(frame["id"].to_numpy(int), frame[name].to_numpy(float), size)
    starts, out, into = by_id(followers.filter("b < 0"), "a"), by_id(inside, "a"), by_id(inside, "b")
    kept = inside.orderBy(F.desc("n"), "a", "b").limit(pairs).select("a", "b", "n").toPandas()
    # whole words have subword ids too, which tell how words are spelled and which ids stand in the same words
    parted = [x or [0] for x in pieces.encode(list(proto.whole))]
    more = pd.DataFrame([(a, b, 1) for ids in parted for a, b in zip(ids, [*ids[1:], END], strict=True)], columns=["a", "b", "n"]).astype("int64")
    kept = pd.concat([kept, more]).groupby(["a", "b"], as_index=False)["n"].sum()
    out, into = (np.bincount(more[key], minlength=size) + dense(frame, "n") for key, frame in (("a", out), ("b", into)))
    begins, kinds = dense(starts, "n"), dense(starts, "kinds")
    begins[END] = ends
    used, firsts = np.unique(np.append(np.flatnonzero(out), BEGIN)), np.unique(np.append(starts["id"].to_numpy(int), END))
    row_of, first_of = np.zeros(size, np.int32), np.zeros(size, np.int32)
    row_of[used], first_of[firsts] = np.arange(1, len(used) + 1), np.arange(1, len(firsts) + 1)

    shares = components(size, kept)
    for i, ids in enumerate(parted, pieces.vocab_size()):
        shares[i] = shares[ids].mean(0)
    parameters, expected = first_parameters(row_of, firsts, begins, shares)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((row_of, first_of, parameters, expected))
        changes = texts.mapInPandas(_train(shared, proto), MESSAGE)
        changes = changes.groupBy("name", "part", "lot").applyInPandas(_added, MESSAGE).groupBy("name", "part").applyInPandas(_added, MESSAGE).toPandas()
        for name, part, change, weight in zip(changes["name"], changes["part"], changes["change"], changes["weight"], strict=True):
            change, weight = np.frombuffer(change, np.float32), np.frombuffer(weight, np.float32)
            rows = expected if name == "theta" else parameters[name]
            change = (change / np.maximum(weight, 1e-12) if len(weight) else change).reshape(-1, rows.shape[1])
            rows[part : part + len(change)] += change
    model = Model(
        proto, row_of, first_of, parameters, expected, Spelling(size, kept, out, into), begins, kinds, discount, dict(zip(head["w"].map(bytes), head["c"].tolist(), strict=True)), ends, total + ends, distinct + bool(ends)
    )
    return model, tail


class Scored(Words):
    """Words with all that scoring asks of them: vectors, rows of theta, counts (-1: beyond the head), and the two
    parts of P(word | first id): what the word's count is divided by, and the chance by its spelling."""

    def __init__(self, model: Model):
        self.of_model, self.chances = model, model.theta()
        super().__init__(model.proto)

    def _clear(self) -> None:
        super()._clear()
        m = self.of_model
        self.vectors, self.firsts = Rows(m.parameters["e"][m.row_of[[BEGIN, END]]]), Rows(m.first_of[[BEGIN, END]])
        self.count, self.over, self.rest = Rows(np.array([0, m.ends])), Rows(np.ones(2)), Rows(np.ones(2))

    def _add(self, new: list[bytes], ids: np.ndarray, length: np.ndarray) -> None:
        m = self.of_model
        super()._add(new, ids, length)
        start = np.cumsum(length) - length
        first = ids[start]
        # a word beyond the head is joined to its count; its chance by spelling is needed either way
        spelled = np.exp(m.spelling.words(ids, length))
        begins = m.begins[first]
        seen = begins > 0
        rest = np.where(seen, m.discount * m.kinds[first] / np.maximum(begins, 1), 1 / m.spelling.size) * spelled
        self.vectors.add(word_rows(m.parameters["e"], m.row_of[ids], start, length))
        self.firsts.add(m.first_of[first])
        self.count.add(np.fromiter(map(m.head.get, new, repeat(-1)), np.int64, len(new)))
        self.over.add(np.where(seen, begins, 1.0))
        self.rest.add(np.maximum(rest, 1e-300))


SCORED = "doc_id {id}, held_out boolean, row long, n_tokens long, n_known long, base double, score double, rare array<binary>, over array<double>, rest array<double>"


def _score(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        words, room = _remembered(model.name, lambda: Scored(model)), model.total + model.vocabulary + 1.0
        row = TaskContext.get().partitionId() << 36
        for lot in _lots(batches):
            rows, (at, entries) = lot.rows, _laid_lot(words, lot)
            vectors, firsts, count, over, rest = (x.all().take(at, 0) for x in (words.vectors, words.firsts, words.count, words.over, words.rest))
            inputs, targets, first = laid_out(entries)
            steps = steps_of(inputs, targets, first)
            leads = np.concatenate([first_chances(model.parameters, words.chances, vectors.take(a.ravel(), 0).reshape(*a.shape, -1), b, c, firsts) for a, b, c in steps])
            flat = targets[targets >= 0]
            n = lot.counts + 1
            of = np.repeat(np.arange(len(n)), n)
            # of each distinct word; those beyond the head add nothing here
            here = count >= 0
            inner = np.where(here, np.log10(np.maximum(count - model.discount, 0) / over + rest), 0.0)
            inner[1] = 0
            base = np.where(here, np.log10((np.maximum(count, 0) + 1) / room), 0.0)
            base, known = np.bincount(of, base[flat], len(n)), np.bincount(of, (count > 0)[flat], len(n)).astype(int)
            score = np.bincount(of, leads, len(n)) / np.log(10) + np.bincount(of, inner[flat], len(n))
            # the words beyond the head, with what their counts are needed for
            rare = np.flatnonzero(~here[flat])
            split = np.searchsorted(of[rare], np.arange(len(n) + 1))
            named = list(map(lot.words.__getitem__, lot.code[rare - of[rare]].tolist()))  # a text has one end, after its words
            lists = lambda x: [x[a:b] for a, b in zip(split[:-1], split[1:], strict=True)]  # noqa: B023, E731
            yield pd.DataFrame({"doc_id": rows["doc_id"].to_numpy(), "held_out": rows["held_out"].to_numpy(), "row": np.arange(row, row + len(n)), "n_tokens": n, "n_known": known, "base": base, "score": score, "rare": lists(named), "over": lists(over[flat[rare]]), "rest": lists(rest[flat[rare]])})
            row += len(n)

    return run


def score(rows: DataFrame, model: Model, tail: DataFrame) -> DataFrame:
    """rows(doc_id, held_out, text binary) -> doc_id, held_out, n_tokens, n_known, base_score, score.

    Words beyond the model's head meet their counts in a join by word; what they add is summed by row.
    """
    room = model.total + model.vocabulary + 1.0
    shared = rows.sparkSession.sparkContext.broadcast(model)
    # written once, so that the numbers of the rows stay what they are
    first = stored(rows.mapInPandas(_score(shared), SCORED.format(id=dict(rows.dtypes)["doc_id"])))
    rare = first.filter(F.size("rare") > 0).select("row", F.explode(F.arrays_zip("rare", "over", "rest")).alias("x")).select("row", F.col("x.rare").alias("w"), "x.over", "x.rest")
    rare = rare.join(tail, "w", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    inner = F.log10(F.greatest(F.col("c") - model.discount, F.lit(0.0)) / F.col("over") + F.col("rest"))
    sums = rare.groupBy(F.col("row").alias("r")).agg(F.sum(F.log10((F.col("c") + 1) / room)).alias("base_more"), F.sum(inner).alias("score_more"), F.count_if(F.col("c") > 0).alias("known_more"))
    out = first.drop("rare", "over", "rest").join(sums, F.col("row") == F.col("r"), "left")
    add = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return out.select("doc_id", "held_out", "n_tokens", add("n_known", "known_more").alias("n_known"), add("base", "base_more").alias("base_score"), add("score", "score_more").alias("score"))


def lm_scores(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, head_words: int = HEAD_WORDS) -> DataFrame:
    """Per document row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Texts whose crc32(doc_id as text) mod 7 is not 2 train; rows with a null id are not held out and train
    too. Null texts are empty: one end token. Repeated rows give repeated rows and count as often; ties of
    any kind change nothing. With nothing to train on, counts are 0 and the model is its first one. An
    empty table gives an empty result. Other columns are left out.
    """
    key = F.col(id_col).cast("string")
    held_out = F.coalesce(F.pmod(F.crc32(key.cast("binary")), F.lit(7)) == 2, F.lit(False))
    docs = documents.select(F.col(id_col).alias("doc_id"), held_out.alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    model, tail = fit(docs.filter(~F.col("held_out")).select("text"), path, head_words)
    out = score(docs, model, tail)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")


def op4_lm_score(spark, sf_dir):
    return lm_scores(table(spark, sf_dir, "documents"))
