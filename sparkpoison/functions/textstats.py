"""Character statistics of whole documents, one Arrow batch at a time.

A document's counts depend on that document alone, so they are computed where its row
already is: nothing is exploded and nothing is shuffled. Exploding 2- to 4-grams instead
would move about fifty times the text through the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: characters handled together; bounds the memory of one step, a longer document is one step
_CHUNK_CHARS = 1_000_000


class Chunk:
    """Several documents as one array of dense character codes."""

    def __init__(self, texts: pa.Array):
        raw = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in texts]
        joined = b"".join(raw)
        points = np.frombuffer(joined.decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        heads = np.concatenate([[0], np.cumsum((np.frombuffer(joined, np.uint8) & 0xC0) != 0x80)])
        ends = heads[np.cumsum([0] + [len(b) for b in raw])]
        self.docs = len(raw)
        self.start = ends[:-1]
        self.length = np.diff(ends)
        self.alphabet, self.code = np.unique(points, return_inverse=True)
        self.code = self.code.astype(np.int64)
        self.size = max(len(self.alphabet), 1)
        self.doc = np.repeat(np.arange(self.docs), self.length)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(doc, first character position, count) of every distinct n-gram of every document."""
        if len(self.code) < n:
            empty = np.zeros(0, np.int64)
            return empty, empty, empty
        stop = len(self.code) - n + 1
        key = self.doc[:stop].astype(np.int64)
        for i in range(n):
            if i and self.docs * float(self.size) ** (n + 1) > 2**62:
                key = np.unique(key, return_inverse=True)[1].astype(np.int64)
            key = key * self.size + self.code[i : stop + i]
        inside = np.flatnonzero(self.doc[:stop] == self.doc[n - 1 :])
        _, first, count = np.unique(key[inside], return_index=True, return_counts=True)
        at = inside[first]
        return self.doc[at], at, count

    def text(self, at: int, n: int) -> str:
        return "".join(map(chr, self.alphabet[self.code[at : at + n]]))

    def per_doc(self, doc: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(doc, weights=weight, minlength=self.docs)

    def window_entropy(self, start: np.ndarray, width: int) -> np.ndarray:
        """Shannon entropy (bits) of the windows of one width beginning at ``start``."""
        out = np.empty(len(start))
        rows = max(1, 4_000_000 // max(self.size, width))
        bits = np.arange(width + 1) * np.log2(np.maximum(np.arange(width + 1), 1))
        for lo in range(0, len(start), rows):
            part = start[lo : lo + rows]
            key = self.code[part[:, None] + np.arange(width)] + np.arange(len(part))[:, None] * self.size
            counts = np.bincount(key.ravel(), minlength=len(part) * self.size).reshape(len(part), self.size)
            out[lo : lo + rows] = np.log2(width) - bits[counts].sum(axis=1) / width
        return out


def chunks(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of an Arrow column holding about _CHUNK_CHARS each."""
    sizes = np.diff(column.offsets.to_numpy()) if hasattr(column, "offsets") else np.array(
        [len(v.as_buffer()) if v.is_valid else 0 for v in column]
    )
    lo = total = 0
    for i, size in enumerate(sizes):
        if i > lo and total + size > _CHUNK_CHARS:
            yield lo, i
            lo, total = i, 0
        total += size
    if lo < len(sizes):
        yield lo, len(sizes)


def char_entropy(chunk: Chunk) -> np.ndarray:
    doc, _, count = chunk.grams(1)
    n = np.maximum(chunk.length, 1)
    return np.where(chunk.length > 0, np.log2(n) - chunk.per_doc(doc, count * np.log2(count)) / n, 0.0)


def bigram_perplexity(chunk: Chunk, shortest: int, short_value: float) -> np.ndarray:
    """2^(-mean log2 P(next|char)) with add-one smoothing over the document's own alphabet."""
    doc1, at1, count1 = chunk.grams(1)
    vocabulary = chunk.per_doc(doc1)
    own = np.unique(doc1 * chunk.size + chunk.code[at1])
    doc, at, count = chunk.grams(2)
    lead = count1[np.searchsorted(own, doc * chunk.size + chunk.code[at])] if len(doc) else count
    logp = np.log2((count + 1) / (lead + vocabulary[doc])) if len(doc) else count
    pairs = np.maximum(chunk.length - 1, 1)
    value = np.exp2(-chunk.per_doc(doc, count * logp) / pairs)
    return np.where(chunk.length < shortest, short_value, value)


def bigram_entropy(chunk: Chunk) -> np.ndarray:
    doc, _, count = chunk.grams(2)
    n = np.maximum(chunk.length - 1, 1)
    return np.where(chunk.length > 1, np.log2(n) - chunk.per_doc(doc, count * np.log2(count)) / n, 0.0)


def coherence(chunk: Chunk) -> np.ndarray:
    """1 - coefficient of variation of the entropy of half-overlapping windows."""
    out = np.ones(chunk.docs)
    widths = np.where(chunk.length >= 50, np.minimum(256, chunk.length // 4), 0)
    for width in np.unique(widths[widths > 0]):
        docs = np.flatnonzero(widths == width)
        step = max(1, width // 2)
        n = (chunk.length[docs] - width) // step + 1
        owner = np.repeat(docs, n)
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        entropy = chunk.window_entropy(chunk.start[owner] + nth * step, int(width))
        total, square = chunk.per_doc(owner, entropy)[docs], chunk.per_doc(owner, entropy**2)[docs]
        mean = total / n
        centred = chunk.per_doc(owner, (entropy - np.repeat(mean, n)) ** 2)[docs]
        std = np.sqrt(centred / n)
        ok = (n >= 2) & (mean >= 1e-12)
        out[docs] = np.where(ok, np.maximum(0.0, 1.0 - std / np.where(ok, mean, 1.0)), 1.0)
    return out


def entropy_windows(chunk: Chunk, width: int = 256, threshold: float = 2.5):
    """(doc, start, entropy, z) of the windows whose entropy stands out within their document."""
    step = max(1, width // 4)
    docs = np.flatnonzero(chunk.length >= width)
    n = (chunk.length[docs] - width) // step + 1
    docs, n = docs[n >= 3], n[n >= 3]
    owner = np.repeat(docs, n)
    start = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * step
    entropy = chunk.window_entropy(chunk.start[owner] + start, width)
    mean = np.repeat(chunk.per_doc(owner, entropy)[docs] / n, n)
    std = np.repeat(np.sqrt(chunk.per_doc(owner, (entropy - mean) ** 2)[docs] / n), n)
    z = np.where(std >= 1e-12, (entropy - mean) / np.where(std >= 1e-12, std, 1.0), 0.0)
    hit = np.abs(z) > threshold
    return owner[hit], start[hit], entropy[hit], z[hit]


def ngram_anomalies(chunk: Chunk, smallest: int = 2, largest: int = 4, threshold: float = 3.0):
    """(doc, n, position, frequency, z, expected high) of n-grams far above their document's mean frequency."""
    parts = []
    for n in range(smallest, largest + 1):
        doc, at, count = chunk.grams(n)
        total = np.maximum(chunk.length - n + 1, 1)
        freq = count / total[doc]
        distinct = np.maximum(chunk.per_doc(doc), 1)
        mean = chunk.per_doc(doc, freq) / distinct
        std = np.sqrt(chunk.per_doc(doc, (freq - mean[doc]) ** 2) / distinct)
        ok = (chunk.length >= 50) & (distinct >= 5) & (std >= 1e-12)
        z = np.where(ok[doc], (freq - mean[doc]) / np.where(ok, std, 1.0)[doc], 0.0)
        hit = z > threshold
        parts.append((doc[hit], np.full(hit.sum(), n), at[hit], freq[hit], z[hit], (mean + 2 * std)[doc[hit]]))
    return [np.concatenate(column) for column in zip(*parts)]
