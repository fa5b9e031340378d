"""Hashes of words and of runs of words, over whole arrays."""

from __future__ import annotations

import numpy as np
import xxhash

from . import worker_tables

_ODD = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """Word -> 64-bit hash, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 40:
            self[word] = h
        return h


_WORDS = _Words()
worker_tables.kind("words", _WORDS.clear)


def hash_words(words: list[bytes]) -> np.ndarray:
    worker_tables.only("words")
    return np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread each value over all 64 bits, one to one."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def grams(hashed: np.ndarray, n: int) -> np.ndarray:
    """One hash for each run of ``n`` words; none if there are fewer words."""
    if len(hashed) < n:
        return np.zeros(0, dtype=np.uint64)
    size = len(hashed) - n + 1
    out = np.zeros(size, dtype=np.uint64)
    for k in range(n):
        out *= _ODD
        out += hashed[k : k + size]
    return mix(out)
