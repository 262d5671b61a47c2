"""Minimal perfect hash over 64-bit keys with stored fingerprints (numpy).

Keys are thrown into a bit array twice their number; those alone in their cell
stay, the others go on to the next, smaller array. A key's number is the rank
of its bit over all arrays, so n keys get 0..n-1 in about 1.6 probes each. A
32-bit fingerprint per number turns away nearly all keys that were never put
in; callers that hold the keys can compare those.
"""

from __future__ import annotations

import numpy as np

GAMMA = 2.0


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit mix (multiply and xor-shift rounds) of unsigned keys under a seed."""
    x = keys ^ np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Levels of packed bits with the rank of each 64-bit word, and fingerprints by number."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray, marks: np.ndarray):
        self.sizes, self.words, self.marks = sizes, words, marks
        counts = np.bitwise_count(words).astype(np.int64)
        self.ranks = np.concatenate([[0], np.cumsum(counts)])
        self.starts = np.concatenate([[0], np.cumsum(sizes // 64)])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """``keys``: different int64 values."""
        left = keys.astype(np.int64).view(np.uint64)
        sizes, words = [], []
        while len(left):
            size = -(-int(GAMMA * len(left)) // 64) * 64
            cell = (mix(left, len(sizes) + 1) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(cell, minlength=size) == 1
            sizes.append(size)
            words.append(np.packbits(alone, bitorder="little").view(np.uint64))
            left = left[~alone[cell]]
        out = cls(np.array(sizes, dtype=np.int64), np.concatenate(words) if words else np.empty(0, np.uint64),
                  np.empty(0, np.uint32))
        numbers = out.number(keys)
        out.marks = np.zeros(len(keys), dtype=np.uint32)
        out.marks[numbers] = cls.mark(keys)
        return out

    @staticmethod
    def mark(keys: np.ndarray) -> np.ndarray:
        return (mix(keys.astype(np.int64).view(np.uint64), 0) >> np.uint64(32)).astype(np.uint32)

    def number(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where no level has its bit."""
        keys = keys.astype(np.int64).view(np.uint64)
        out = np.full(len(keys), -1, dtype=np.int64)
        todo = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(todo):
                break
            cell = (mix(keys[todo], level + 1) % np.uint64(size)).astype(np.int64)
            word = self.starts[level] + cell // 64
            bit = np.uint64(1) << (cell % 64).astype(np.uint64)
            hit = (self.words[word] & bit) != 0
            below = np.bitwise_count(self.words[word] & (bit - np.uint64(1))).astype(np.int64)
            out[todo[hit]] = (self.ranks[word] + below)[hit]
            todo = todo[~hit]
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """As number(), and -1 where the stored fingerprint differs."""
        at = self.number(keys)
        ok = at >= 0
        ok[ok] = self.marks[at[ok]] == self.mark(keys[ok])
        return np.where(ok, at, -1)
