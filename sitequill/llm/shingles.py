"""Hashed word shingles of a text; plain helpers that run inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd multipliers for the places in a shingle.
_PLACES = np.array(
    [xxhash.xxh3_64_intdigest(b"place", seed=i) | 1 for i in range(64)], dtype=np.uint64
)
#: Words kept in a task's memory.
CACHE_WORDS = 300_000


class WordHashes(dict):
    """64-bit hashes of words, kept for those seen lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: bytes | None, width: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of `width` words of the whole text.

    A-Z are lower-cased; words end at ASCII white space. A text of fewer words is one shingle,
    one without words has none. Two shingles of a corpus share a hash with probability 2^-64.
    """
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    run = min(width, len(words))
    total = np.full(len(words) - run + 1, xxhash.xxh3_64_intdigest(b"run", seed=run), np.uint64)
    for i in range(run):
        total += hashes[i : len(words) - run + 1 + i] * _PLACES[i % 64]
    return np.unique(mixed(total))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def set_key(shingles: np.ndarray) -> int:
    """A signed 64-bit key of a whole set."""
    value = xxhash.xxh3_64_intdigest(shingles.tobytes())
    return value - (1 << 64) if value >= 1 << 63 else value
