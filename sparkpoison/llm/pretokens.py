"""Where a byte-level tokenizer cuts text into pieces, without a regular expression.

Code points become classes, classes become functions on the eight states of a small
automaton, and the functions of a text compose associatively. There are few different
compositions (the automaton's transition monoid), so a composition is one look-up in a
table, and a blocked prefix scan over a chunk of texts gives the state at every code point:
inside blocks column by column for all blocks at once, then over the blocks' totals by the
same scan, then both together. A text's first code point maps every state to the same one,
so texts can lie side by side.

The cuts are those of the pattern
's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
"""

from __future__ import annotations

import unicodedata
import zlib
from functools import lru_cache

import numpy as np

# White space of the pattern's \s.
WHITE_SPACE = (
    *range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
# Letters and numbers of Unicode 16.0 that Unicode 15.1 does not have, as first, last.
LETTERS_16 = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5),
    (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA),
    (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NUMBERS_16 = (
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79),
    (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA),
)

# Classes of a code point, then symbols that know what follows.
LETTER, NUMBER, OTHER, SPACE, WHITE, APOSTROPHE = range(6)
MIDDLE, LAST_SPACE, LAST_WHITE, SHORT, LONG = SPACE, WHITE, APOSTROPHE, 6, 7  # symbols beyond LETTER, NUMBER, OTHER
SYMBOLS = 8

# States: what is open behind the last code point.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_SPACE, IN_WHITE, ONE_MORE, TWO_MORE = range(8)

_BLOCK = 64


@lru_cache(maxsize=1)
def class_table() -> bytes:
    """Compressed class of every code point; built where the query is planned, sent to the tasks."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.full(0x110000, OTHER, np.uint8)
    for point in range(0x110000):
        kind = kinds.get(unicodedata.category(chr(point))[0])
        if kind is not None:
            table[point] = kind
    for ranges, kind in ((LETTERS_16, LETTER), (NUMBERS_16, NUMBER)):
        for first, last in ranges:
            table[first : last + 1] = kind
    table[list(WHITE_SPACE)] = WHITE
    table[ord(" ")], table[ord("'")] = SPACE, APOSTROPHE
    return zlib.compress(table.tobytes(), 9)


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """Next state, and whether a piece begins at this symbol."""
    if symbol == MIDDLE:
        return IN_WHITE, state != IN_WHITE
    if symbol == LAST_SPACE:  # goes with what follows
        return AFTER_SPACE, True
    if symbol == LAST_WHITE:
        return FRESH, True
    if symbol == LETTER and state in (ONE_MORE, TWO_MORE):
        return (FRESH, False) if state == ONE_MORE else (ONE_MORE, False)
    run = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS}.get(symbol, IN_OTHER)
    if state in (run, AFTER_SPACE):
        return run, False
    if symbol in (SHORT, LONG):  # a contraction, only where a piece begins
        return (ONE_MORE if symbol == SHORT else TWO_MORE), True
    return run, True


class Pretokenizer:
    def __init__(self, table: bytes):
        self.classes = np.frombuffer(zlib.decompress(table), np.uint8)
        states = range(8)
        self.begins = np.array([[_step(q, s)[1] for s in range(SYMBOLS)] for q in states])
        moves = [tuple(_step(q, s)[0] for q in states) for s in range(SYMBOLS)]
        starts = [(_step(FRESH, s)[0],) * 8 for s in range(SYMBOLS)]
        self.base, self.maps, self.table = _monoid([*moves, *starts])

    def states(self, ids: np.ndarray) -> np.ndarray:
        """State behind each function, from FRESH."""
        return self.maps[self._scan(ids), FRESH]

    def _scan(self, ids: np.ndarray) -> np.ndarray:
        """Inclusive prefix compositions."""
        n = len(ids)
        if n <= _BLOCK:
            out = ids.copy()
            for i in range(1, n):
                out[i] = self.table[out[i - 1], out[i]]
            return out
        blocks = -(-n // _BLOCK)
        padded = np.zeros(blocks * _BLOCK, ids.dtype)  # the identity
        padded[:n] = ids
        grid = np.ascontiguousarray(padded.reshape(blocks, _BLOCK).T)
        for i in range(1, _BLOCK):
            grid[i] = self.table[grid[i - 1], grid[i]]
        before = np.zeros(blocks, ids.dtype)
        before[1:] = self._scan(grid[-1])[:-1]
        return self.table[before[None, :], grid].T.reshape(-1)[:n]

    def split(self, texts: list[bytes]) -> tuple[str, np.ndarray, np.ndarray]:
        """(all text, first code point of every piece and the end, number of pieces of every text)."""
        joined = b"".join(texts)
        whole = joined.decode("utf-8")
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        n = len(points)
        if not n:
            return whole, np.zeros(1, np.int64), np.zeros(len(texts), np.int64)
        if len(joined) == n:
            heads = np.cumsum([0] + [len(t) for t in texts])
        else:
            chars = np.concatenate([[0], np.cumsum((np.frombuffer(joined, np.uint8) & 0xC0) != 0x80)])
            heads = chars[np.cumsum([0] + [len(t) for t in texts])]
        start = np.zeros(n + 1, bool)
        start[heads] = True  # also behind the last
        kind = self.classes[points]
        symbol = self._symbols(points, kind, start)
        ids = self.base[symbol + SYMBOLS * start[:n]]
        after = self.states(ids)
        before = np.empty(n, np.int64)
        before[0] = FRESH
        before[1:] = after[:-1]
        begins = self.begins[before, symbol] | start[:n]
        cuts = np.flatnonzero(begins)
        per_text = np.diff(np.searchsorted(cuts, heads))
        return whole, np.append(cuts, n), per_text

    @staticmethod
    def _symbols(points: np.ndarray, kind: np.ndarray, start: np.ndarray) -> np.ndarray:
        n = len(points)
        white = (kind == SPACE) | (kind == WHITE)
        # The last of a run of white space, if more of the same text follows.
        followed = np.zeros(n, bool)
        followed[:-1] = white[:-1] & ~white[1:] & ~start[1:n]
        symbol = kind.copy()
        symbol[white] = MIDDLE
        symbol[followed & (kind == SPACE)] = LAST_SPACE
        symbol[followed & (kind == WHITE)] = LAST_WHITE
        symbol[kind == APOSTROPHE] = OTHER
        at = np.flatnonzero(kind == APOSTROPHE)
        if len(at):
            padded = np.concatenate([points, np.zeros(2, np.uint32)])
            ends = np.concatenate([start, [True]])
            one, two = padded[at + 1], padded[at + 2]
            inside_one, inside_two = ~ends[at + 1], ~ends[at + 1] & ~ends[np.minimum(at + 2, n)]
            # The pattern's contractions.
            short = inside_one & np.isin(one, [ord(c) for c in "stmd"])
            long = inside_two & np.isin(one.astype(np.uint64) << 32 | two, [ord(a) << 32 | ord(b) for a, b in ("re", "ve", "ll")])
            symbol[at[short]], symbol[at[long]] = SHORT, LONG
        return symbol


def _monoid(generators: list[tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of each generator, state maps by number, composition table); number 0 is the identity."""
    found = {tuple(range(8)): 0}
    queue = [tuple(range(8))]
    for f in queue:
        for g in generators:
            h = tuple(g[q] for q in f)
            if h not in found:
                found[h] = len(found)
                queue.append(h)
    maps = np.array(queue, np.uint8)
    table = np.array([[found[tuple(g[q] for q in f)] for g in queue] for f in queue], np.uint8 if len(queue) <= 256 else np.uint16)
    return np.array([found[g] for g in generators], table.dtype), maps, table
