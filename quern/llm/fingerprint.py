"""Vectorised 64-bit fingerprints shared by the byte- and shingle-level operators."""

from __future__ import annotations

import numpy as np
import xxhash

# Odd 64-bit multipliers of public-domain mixers.
_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xC2B2AE3D27D4EB4F)
_C = np.uint64(0xBF58476D1CE4E5B9)
_R29, _R32 = np.uint64(29), np.uint64(32)


def mix(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Order-sensitive 64-bit name of the pair (x, y), elementwise."""
    h = x * _A
    h ^= h >> _R32
    h += y
    h *= _B
    h ^= h >> _R29
    h *= _C
    h ^= h >> _R32
    return h


class WordHashes(dict):
    """word -> 64-bit hash, computed once while it stays in a bounded memory."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_hashes(words: list[bytes], k: int, memo: WordHashes) -> np.ndarray:
    """64-bit hash of each k-word shingle in order; fewer words make one shingle; none makes none."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    if len(h) < k:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes())], np.uint64)
    out = h[: len(h) - k + 1]
    for i in range(1, k):
        out = mix(out, h[i : len(h) - k + 1 + i])
    return out
