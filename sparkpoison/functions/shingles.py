"""Word shingles as hashes: made where the text is, dealt to buckets, counted a bucket at a time.

A shingle is told from others by its bucket and 72 bits of hash. Only arrays travel: a row holds all the shingles that
some million shingles of neighbouring documents have in one bucket, so a shingle takes about 11 bytes. One that many of
these documents hold is a row of its own with their ids, so what a bucket has to order stays small for frequent ones, too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: bytes of text hashed at a time, and shingles dealt at a time
PIECE, DEAL = 1 << 21, 1 << 20
#: documents of one deal from which on those of a shingle are a row of their own
FREQUENT = 64
#: most buckets, so that their numbers sort as 16 bits
MOST_BUCKETS = 1 << 16
#: what a row holds: shingles of a bucket, documents of a frequent shingle, or documents with their numbers of shingles
ITEMS, ONE, TOTALS = 0, 1, 2
ROW = "bucket int, kind int, base bigint, width int, ids binary, hashes binary, checks binary"
FOUND = "kind int, base bigint, width int, ids binary, amounts binary"

_MIX, _ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_INSIDE = np.ones(256, bool)
_INSIDE[list(b" \t\n\f\r")] = False
_KINDS = {2: "<u2", 4: "<u4", 8: "<i8"}


def _mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values: every bit of the input moves half of the output."""
    h = (h ^ (h >> np.uint64(32))) * _ODD
    h = (h ^ (h >> np.uint64(32))) * _ODD
    return h ^ (h >> np.uint64(32))


_LETTERS = _mix(np.arange(1, 257, dtype=np.uint64) * _MIX)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, words of every text); words are what stands between white space."""
    raw = np.frombuffer(b"".join(t + b" " for t in texts), np.uint8)
    inside = _INSIDE[raw]
    edges = np.flatnonzero(np.diff(inside, prepend=False))
    start, end = edges[::2], edges[1::2]
    heads = np.cumsum([0, *(len(t) + 1 for t in texts)])
    per_text = np.diff(np.searchsorted(start, heads))
    if not len(start):
        return np.zeros(0, np.uint64), per_text
    length = end - start
    ends = np.cumsum(length)
    powers = np.full(int(length.max()), _MIX, np.uint64)
    powers[0] = 1
    place = np.arange(ends[-1]) - np.repeat(ends - length, length)
    values = _LETTERS[raw[inside]] * np.multiply.accumulate(powers)[place]
    return _mix(np.add.reduceat(values, ends - length) + length.astype(np.uint64) * _ODD), per_text


def shingle_hashes(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, hash, second hash) of every shingle in the order of the texts; a shorter text is one shingle."""
    hashes, per_text = word_hashes(texts)
    count = np.where(per_text > 0, np.maximum(per_text - words + 1, 1), 0)
    owner = np.repeat(np.arange(len(texts)), count)
    before = np.cumsum(per_text) - per_text
    first = np.arange(len(owner)) + np.repeat(before - (np.cumsum(count) - count), count)
    held = np.repeat(np.minimum(per_text, words), count)
    short = bool((held < words).any())
    padded = np.concatenate([hashes, np.zeros(words, np.uint64)])
    one, two = (np.zeros(len(owner), np.uint64) for _ in "ab")
    factors = _mix(np.arange(2 * words, dtype=np.uint64) + _MIX) | np.uint64(1)
    for i in range(words):
        word = padded[first + i]
        if short:
            word[held <= i] = 0
        one += word * factors[i]
        two += word * factors[words + i]
    return owner, _mix(one), _mix(two)


def _packed(ids: np.ndarray) -> tuple[int, int, np.ndarray]:
    """(base, width, ids less the base in that many bytes)."""
    low, high = int(ids.min()), int(ids.max())
    width = next(w for w, most in ((2, 1 << 16), (4, 1 << 32), (8, 1 << 65)) if high - low < most)
    base = low if width < 8 else 0
    return base, width, (ids - base).astype(_KINDS[width])


def _unpacked(base: int, width: int, ids: memoryview) -> np.ndarray:
    return np.frombuffer(ids, _KINDS[width]).astype(np.int64) + base


def _slices(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The bytes of values[cuts[0]:cuts[1]], values[cuts[1]:cuts[2]], …"""
    offsets = (cuts * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])


def _rows(bucket: np.ndarray, kind: int, base: int, ids: np.ndarray, cuts: np.ndarray, hashes: pa.Array, checks: pa.Array) -> pa.RecordBatch:
    n = len(bucket)
    return pa.RecordBatch.from_pydict({
        "bucket": pa.array(bucket.astype(np.int32)), "kind": pa.array(np.full(n, kind, np.int32)), "base": pa.array(np.full(n, base, np.int64)),
        "width": pa.array(np.full(n, ids.itemsize, np.int32)), "ids": _slices(ids, cuts), "hashes": hashes, "checks": checks,
    })


def _order(hashes: np.ndarray, seconds: np.ndarray, kind: str | None = None) -> np.ndarray:
    """Places in the order of both; the second one is looked at only where it differs under one first."""
    order = np.argsort(hashes, kind=kind)
    h, s = hashes[order], seconds[order]
    return np.lexsort((seconds, hashes)) if ((h[1:] == h[:-1]) & (s[1:] != s[:-1])).any() else order


def _begins(hashes: np.ndarray, seconds: np.ndarray) -> np.ndarray:
    """Whether a place differs from the one before it."""
    out = np.ones(len(hashes), bool)
    out[1:] = (hashes[1:] != hashes[:-1]) | (seconds[1:] != seconds[:-1])
    return out


def _dealt(ids: np.ndarray, owner: np.ndarray, one: np.ndarray, two: np.ndarray, buckets: int, frequent: int) -> Iterator[pa.RecordBatch]:
    """Rows of the shingles of documents ``ids``, each counted once a document."""
    bucket, check = ((two & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.uint16), (two >> np.uint64(56)).astype(np.uint8)
    base, width, packed = _packed(ids)
    order = _order(one, two, "stable")  # documents stay in order under a shingle
    begins, mine = _begins(one[order], two[order]), owner[order]
    keep = begins.copy()
    keep[1:] |= mine[1:] != mine[:-1]
    order, begins = order[keep], begins[keep]
    totals = np.bincount(owner[order], minlength=len(ids))
    some = np.flatnonzero(totals)
    yield _rows(bucket[:1], TOTALS, base, packed[some], np.array([0, len(some)]), pa.array([totals[some].astype("<i8").tobytes()], pa.binary()), pa.array([b""], pa.binary()))

    cuts = np.append(np.flatnonzero(begins), len(order))
    often = np.diff(cuts) >= frequent
    if often.any():
        at, lengths = order[cuts[:-1][often]], np.diff(cuts)[often]
        theirs = packed[owner[order[np.repeat(often, np.diff(cuts))]]]
        each = np.arange(len(at) + 1)
        yield _rows(bucket[at], ONE, base, theirs, np.concatenate([[0], np.cumsum(lengths)]), _slices(one[at], each), _slices(check[at], each))
    order = np.sort(order[np.repeat(~often, np.diff(cuts))])  # by documents
    order = order[np.argsort(bucket[order], kind="stable")]
    if len(order):
        mine = bucket[order]
        cuts = np.concatenate([[0], np.flatnonzero(mine[1:] != mine[:-1]) + 1, [len(order)]])
        yield _rows(mine[cuts[:-1]], ITEMS, base, packed[owner[order]], cuts, _slices(one[order], cuts), _slices(check[order], cuts))


def deal(batches: Iterator[pa.RecordBatch], words: int, buckets: int, frequent: int) -> Iterator[pa.RecordBatch]:
    """``ROW`` of batches (id, text)."""
    held: list[tuple] = []

    def flushed() -> Iterator[pa.RecordBatch]:
        columns = [np.concatenate(x) for x in zip(*held)]
        held.clear()
        yield from _dealt(*columns, buckets, frequent)

    for batch in batches:
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0)))
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + PIECE, side="right")))
            texts = [b"" if t is None else t for t in batch.column(1).slice(low, high - low).cast(pa.binary()).to_pylist()]
            owner, one, two = shingle_hashes(texts, words)
            if len(owner):
                known = sum(len(h[0]) for h in held)
                held.append((batch.column(0).slice(low, high - low).to_numpy(), owner + known, one, two))
            if sum(len(h[1]) for h in held) >= DEAL:
                yield from flushed()
            low = high
    if held:
        yield from flushed()


def count(table: pa.Table) -> pa.Table:
    """``FOUND`` of one bucket: documents of shingles that several documents hold, with how many hold them; totals as they are."""
    kinds = table.column("kind").to_numpy()
    column = lambda name, kind: [v.as_buffer() for v in table.column(name).filter(pa.array(kinds == kind)).combine_chunks()]
    shape = lambda kind: zip(*(table.column(c).filter(pa.array(kinds == kind)).to_pylist() for c in ("base", "width")))
    whole = lambda values, kind: np.frombuffer(b"".join(values), kind)
    docs = [_unpacked(b, w, v) for (b, w), v in zip(shape(ITEMS), column("ids", ITEMS))]
    ids = np.concatenate([np.zeros(0, np.int64), *docs])
    hot, hot_shape = column("ids", ONE), list(shape(ONE))
    weight = np.concatenate([np.ones(len(ids), np.int64), np.array([len(v) // w for v, (_, w) in zip(hot, hot_shape)], np.int64)])
    hashes = whole(column("hashes", ITEMS) + column("hashes", ONE), "<u8")
    checks = whole(column("checks", ITEMS) + column("checks", ONE), np.uint8)
    order = _order(hashes, checks)
    begins = _begins(hashes[order], checks[order])
    holders = np.zeros(len(order), np.int64)
    if len(order):
        holders[order] = np.add.reduceat(weight[order], np.flatnonzero(begins))[np.cumsum(begins) - 1]
    single = holders[: len(ids)]
    copied = single > 1
    rows = [(ITEMS, 0, 8, ids[copied].tobytes(), single[copied].tobytes())] if copied.any() else []
    rows += [(ONE, b, w, v.to_pybytes(), n.tobytes()) for (b, w), v, n in zip(hot_shape, hot, holders[len(ids) :])]
    rows += [(TOTALS, b, w, v.to_pybytes(), t.to_pybytes()) for (b, w), v, t in zip(shape(TOTALS), column("ids", TOTALS), column("hashes", TOTALS))]
    names = [("kind", pa.int32()), ("base", pa.int64()), ("width", pa.int32()), ("ids", pa.binary()), ("amounts", pa.binary())]
    return pa.table({name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(names)})


def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, shingles, copied, widest), to be added up a document, of ``FOUND``."""
    for batch in batches:
        for kind, base, width, ids, amounts in zip(*(batch.column(i) for i in range(5))):
            docs = _unpacked(base.as_py(), width.as_py(), ids.as_buffer())
            n = np.broadcast_to(np.frombuffer(amounts.as_buffer(), "<i8"), len(docs))
            total = kind.as_py() == TOTALS
            none, some = np.zeros(len(docs), np.int64), np.ones(len(docs), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (docs, n if total else none, none if total else some, some if total else n)], ["id", "shingles", "copied", "widest"])
