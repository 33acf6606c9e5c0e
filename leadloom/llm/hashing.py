"""Vectorised hashes of word sequences."""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd multipliers of two independent polynomial hashes, and words that a Python worker remembers.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
REMEMBERED = 300_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_WORDS = _WordHashes()


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


class Sequences:
    """Hashes of all runs of k words in a list of words, from prefix sums of a polynomial modulo 2^64."""

    def __init__(self, hashes: np.ndarray, which: int = 0) -> None:
        n = len(hashes)
        base = BASES[which]
        own = mixed(hashes + np.uint64(which))
        with np.errstate(over="ignore"):
            power = np.cumprod(np.full(n, base, np.uint64))
            self.inverse = np.cumprod(np.full(n, pow(base, -1, 1 << 64), np.uint64))
            self.sums = np.concatenate([[np.uint64(0)], np.cumsum(own * power)])
        self.n = n

    def runs(self, k: int) -> np.ndarray:
        """Hash of the k words from each position on; n - k + 1 values."""
        if self.n < k:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            return mixed((self.sums[k:] - self.sums[:-k]) * self.inverse[: self.n - k + 1])
