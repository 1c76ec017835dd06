"""Words of a chunk of texts as arrays: places, owners and 64-bit hashes."""

from __future__ import annotations

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values: every bit of the input moves half of the output."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * _ODD
        h = (h ^ (h >> np.uint64(32))) * _ODD
        return h ^ (h >> np.uint64(32))


def letter_values() -> np.ndarray:
    """A 64-bit value for each byte, the same in every task."""
    return mix((np.arange(1, 257, dtype=np.uint64)) * _MIX)


class Words:
    """Runs of bytes for which ``part_of_word`` is true; A-Z are lower-cased; no word crosses texts.

    ``start`` and ``end`` are byte places in the joined texts, ``owner`` the text's number,
    ``first`` the number of each text's first word (and the end).
    """

    def __init__(self, texts: list[bytes], part_of_word: np.ndarray):
        raw = np.frombuffer(b"".join(texts), np.uint8)
        self.raw = raw
        self.bytes = raw + ((raw >= 65) & (raw <= 90)).astype(np.uint8) * np.uint8(32)
        self.heads = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]).astype(np.int64)
        inside = part_of_word[raw]
        n = len(raw)
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        heads = self.heads[:-1]
        edge = heads[(heads > 0) & (heads < n)]
        before[edge] = False
        after[edge - 1] = False
        self.inside = inside
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, self.heads)
        self.owner = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """A hash of every word's lower-cased bytes: a polynomial in an odd base, mixed."""
        length = self.end - self.start
        if not len(length):
            return np.zeros(0, np.uint64)
        values = letter_values()[self.bytes[self.inside]]
        ends = np.cumsum(length)
        place = np.arange(ends[-1]) - np.repeat(ends - length, length)
        with np.errstate(over="ignore"):
            powers = np.full(int(length.max()), _MIX, np.uint64)
            powers[0] = 1
            powers = np.multiply.accumulate(powers)
            summed = np.add.reduceat(values * powers[place], ends - length)
            return mix(summed + length.astype(np.uint64) * _ODD)

    def text(self, word: int) -> bytes:
        return self.bytes[self.start[word] : self.end[word]].tobytes()


def white_space_words() -> np.ndarray:
    """[^\\x20\\x09-\\x0D]+ : everything but ASCII white space."""
    table = np.ones(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = False
    return table


def alphanumeric_words() -> np.ndarray:
    """[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z: ASCII digits and letters, and all beyond ASCII."""
    table = np.zeros(256, bool)
    table[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
    return table
