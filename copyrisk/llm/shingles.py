"""Word shingles of whole texts as 64-bit hashes, and MinHash samples of them, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

WORDS = 5
_MIX = np.uint64(0x9E3779B97F4A7C15)
_WEIGHTS = np.random.default_rng(5).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
#: Words whose hashes a Python worker remembers; the table starts anew beyond that.
REMEMBERED = 200_000


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _WordHash()


def forget_words() -> None:
    """Empties the worker's table of words, whose memory tasks of other operators may need."""
    _HASHES.clear()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def shingle_set(raw: bytes, n: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the ``n``-word shingles of a text in UTF-8.

    A-Z are lower-cased and words end at ASCII white space.  A text of fewer than ``n`` words
    is one shingle; a text without words has none.
    """
    words = raw.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    width = min(n, len(words))
    total = np.full(len(words) - width + 1, width, np.uint64) * _MIX
    for j in range(width):
        total += ids[j : len(ids) - width + 1 + j] * _WEIGHTS[j]
    return np.unique(mix(total))


class MinHasher:
    """``samples`` MinHash values of a shingle set, by multiplication on 32-bit values."""

    def __init__(self, samples: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.samples = samples
        self.a = rng.integers(1, 1 << 32, samples, dtype=np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, samples, dtype=np.uint32)

    def __call__(self, hashes: np.ndarray, step: int = 2048) -> np.ndarray:
        """For a set that isn't empty."""
        x = (hashes >> np.uint64(32)).astype(np.uint32)
        x ^= x >> np.uint32(15)
        out = np.full(self.samples, 0xFFFFFFFF, np.uint32)
        for i in range(0, len(x), step):
            y = x[None, i : i + step] * self.a[:, None]
            y ^= self.b[:, None]
            y ^= y >> np.uint32(16)
            y *= np.uint32(0x85EBCA6B)
            out = np.minimum(out, y.min(1))
        return out
