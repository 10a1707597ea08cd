"""Word hashes and rolling window hashes in numpy, for the operators that work on batches in tasks."""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd multipliers of the rolling hash and of the mixing steps.
BASE = 0x9E3779B97F4A7C15
MIX_1 = 0xFF51AFD7ED558CCD
MIX_2 = 0xC4CEB9FE1A85EC53
#: Words remembered in one Python worker; the memory starts anew beyond it.
MEMORY = 400_000


class WordHasher(dict):
    """word -> 64-bit hash, remembered while a worker lives."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMORY:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def codes(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


HASHER = WordHasher()


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that their order is as good as random."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(MIX_1)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(MIX_2)
    return x ^ (x >> np.uint64(32))


_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        size = 1 << (n - 1).bit_length()
        for name, value in (("_powers", BASE), ("_inverses", pow(BASE, -1, 1 << 64))):
            steps = np.full(size, value, np.uint64)
            steps[0] = 1
            globals()[name] = np.cumprod(steps)


class Rolling:
    """Hashes of any span of a sequence of word codes, equal for equal spans wherever they stand."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        _grow(n + 1)
        self.n = n
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(codes * _powers[:n], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * _inverses[start])

    def windows(self, size: int) -> np.ndarray:
        count = self.n - size + 1
        if count <= 0:
            return np.zeros(0, np.uint64)
        return mixed((self.sums[size:] - self.sums[:count]) * _inverses[:count])


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """Least of every `size` neighbours, by doubling."""
    if len(x) < size:
        return x[:0]
    have, count = 1, len(x) - size + 1
    while have * 2 <= size:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = size - have
    return np.minimum(x[:count], x[rest : rest + count])


def signed(x: np.ndarray) -> np.ndarray:
    """The same bits as Spark's long."""
    return x.view(np.int64)
