"""Minimal perfect hash of a set of 64-bit keys: n keys to 0 .. n - 1 in about three bits a key, in arrays."""

from __future__ import annotations

import numpy as np

from sparkpoison.llm.words import mix

#: places of a level for every key that is left
_SPARE = 2


class MinimalHash:
    """Levels of bit arrays: a key alone at its place of a level stays there, the others go on to the next level.

    A key's index is the number of bits set before its own. ``keys`` holds every key at its index, so
    ``index`` tells a key of the set from any other, for which it returns -1.
    """

    def __init__(self, keys: np.ndarray):
        left = np.unique(np.asarray(keys, np.int64))
        self.n, self.sizes, words = len(left), [], []
        while len(left):
            size = -(-_SPARE * len(left) // 64) * 64
            at = self._place(left, len(self.sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            self.sizes.append(size)
            left = left[~alone[at]]
        self.words = np.concatenate(words) if words else np.zeros(0, np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones
        self.keys = np.zeros(0, np.int64)
        wanted = np.unique(np.asarray(keys, np.int64))
        placed = np.zeros(self.n, np.int64)
        placed[self._index(wanted)] = wanted
        self.keys = placed

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        seed = mix(np.array([level + 1], np.uint64))[0]
        return (mix(keys.view(np.uint64) ^ seed) % np.uint64(size)).astype(np.int64)

    def _index(self, keys: np.ndarray) -> np.ndarray:
        """The index of keys of the set; anything, or -1, for others."""
        keys = np.ascontiguousarray(keys, np.int64)
        out, open_, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            at = self._place(keys[open_], level, size)
            word, bit = base + at // 64, (at % 64).astype(np.uint64)
            hit = (self.words[word] >> bit) & np.uint64(1) == 1
            below = self.words[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[open_[hit]] = self.before[word[hit]] + np.bitwise_count(below)
            open_, base = open_[~hit], base + size // 64
        return out

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The index of every key, -1 where it is not in the set."""
        keys = np.asarray(keys, np.int64)
        out = self._index(keys)
        known = out >= 0
        known[known] = self.keys[out[known]] == keys[known]
        return np.where(known, out, -1)
