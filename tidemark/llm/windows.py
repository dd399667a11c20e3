"""Windows over sequences: hashes of consecutive items and the anchor that equal windows share."""

from __future__ import annotations

import numpy as np
import xxhash

POSITION_BITS = 28


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """XXH64 of words; each distinct word is hashed once, until the table reaches a bound and is emptied."""

    def __init__(self, most: int = 500_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive items, from the items' hashes; equal runs and, but for 64-bit chance, only they have equal hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = (out ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return mix(out)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    size = 1
    while size * 2 <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:n], x[w - size : w - size + n])


def anchors(grams: np.ndarray, w: int) -> np.ndarray:
    """For each w consecutive gram hashes, the position of the least (leftmost on ties). It depends on the window's content alone, so
    equal windows have it at the same offset."""
    low = np.uint64((1 << POSITION_BITS) - 1)
    if len(grams) > int(low):
        raise ValueError("a text of more than 2^28 items")
    packed = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    return (sliding_min(packed, w) & low).astype(np.int64)
