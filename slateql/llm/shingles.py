"""Word shingles as sorted arrays of 64-bit hashes, computed in Arrow batches."""

from __future__ import annotations

import numpy as np
import xxhash

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


class WordHashes(dict):
    """word bytes -> 64-bit hash; forgets everything at ``limit`` words."""

    def __init__(self, limit: int = 250_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h

    def of(self, ws: list[bytes]) -> np.ndarray:
        if len(self) > self.limit:
            self.clear()
        return np.fromiter(map(self.__getitem__, ws), np.uint64, len(ws))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return h ^ (h >> np.uint64(29))


def shingle_set(text: bytes | None, cache: WordHashes, width: int = 5) -> np.ndarray:
    """The distinct shingles of ``width`` words, A-Z lower-cased; a shorter text is one shingle, one without words none."""
    ws = (text or b"").lower().split()  # bytes: A-Z only, and exactly the six ASCII separators
    if not ws:
        return np.empty(0, np.uint64)
    if len(ws) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(ws), seed=len(ws))], np.uint64)
    h = cache.of(ws)
    n = len(h) - width + 1
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total += mixed(h[k : k + n] * _MULTIPLIERS[k % 5] + np.uint64(k))
    return np.unique(mixed(total))
