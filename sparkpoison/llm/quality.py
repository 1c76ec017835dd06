"""Quality classifier: gradient-boosted trees over statistics of a document's text.

Statistics are array operations over chunks of texts. Trees are grown on histograms of
binned statistics from a bounded sample of labelled rows; the finished forest is a few
arrays, and scoring walks all trees for all documents of a chunk, one level at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sparkpoison.llm.common import map_texts, read, text_bytes
from sparkpoison.llm.words import Words, white_space_words

STATISTICS = (
    "log_bytes", "log_words", "word_length", "word_length_sd", "long_words", "short_words", "upper", "lower", "digit",
    "white", "beyond_ascii", "full_stop", "comma", "exclamation", "marks", "bars", "angle", "slash", "caps_words", "odd_ends",
    "starts_upper", "repeats", "distinct_words", "top_pair", "lines_per_word", "distinct_lines", "line_length", "short_lines",
)


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of STATISTICS per text, all 0 for an empty text."""
    w = Words(texts, white_space_words())
    n, raw, heads = len(texts), w.raw, w.heads
    size = np.diff(heads)
    some = np.maximum(size, 1)

    def share(flag: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flag)])
        return np.diff(total[heads]) / some

    def among(*chars: str) -> np.ndarray:
        table = np.zeros(256, bool)
        table[[ord(c) for part in chars for c in part]] = True
        return table[raw]

    upper, lower = (raw >= 65) & (raw <= 90), (raw >= 97) & (raw <= 122)
    digit = (raw >= 48) & (raw <= 57)
    per_text = lambda values=None: np.bincount(w.owner, weights=values, minlength=n)[:n]
    words = per_text()
    of = np.maximum(words, 1)
    length = (w.end - w.start).astype(float)
    mean = per_text(length) / of
    total_upper = np.concatenate([[0], np.cumsum(upper)])
    total_letter = np.concatenate([[0], np.cumsum(upper | lower)])
    letters = total_letter[w.end] - total_letter[w.start]
    caps = (letters > 1) & (total_upper[w.end] - total_upper[w.start] == letters)
    last = raw[w.end - 1] if len(w.end) else raw[:0]
    odd = ~(((last >= 48) & (last <= 57)) | ((last >= 65) & (last <= 90)) | ((last >= 97) & (last <= 122)) | (last >= 128) | np.isin(last, [44, 46]))
    hashes = w.hashes()
    same = np.zeros(len(hashes), bool)
    if len(hashes) > 1:
        same[1:] = (hashes[1:] == hashes[:-1]) & (w.owner[1:] == w.owner[:-1])
    distinct, _ = _groups(w.owner, hashes, n)
    with np.errstate(over="ignore"):
        inner = w.owner[1:] == w.owner[:-1]
        pairs = (hashes[1:] * np.uint64(3) + hashes[:-1])[inner]
    _, top = _groups(w.owner[1:][inner], pairs, n)
    line = np.ones(256, bool)
    line[10] = False
    lw = Words(texts, line)
    lines = np.bincount(lw.owner, minlength=n)[:n]
    line_of = np.maximum(lines, 1)
    line_length = (lw.end - lw.start).astype(float)
    distinct_lines, _ = _groups(lw.owner, lw.hashes(), n)
    columns = [
        np.log1p(size), np.log1p(words), mean, np.sqrt(np.maximum(per_text(length**2) / of - mean**2, 0)), per_text(length > 14) / of,
        per_text(length < 3) / of, share(upper), share(lower), share(digit), share(~w.inside), share(raw >= 128), share(among(".")),
        share(among(",")), share(among("!?")), share(among("*&%$#@^~")), share(among("|")), share(among("<>{}[]")), share(among("/\\_=")),
        per_text(caps) / of, per_text(odd) / of, per_text(((raw[w.start] >= 65) & (raw[w.start] <= 90)) if len(w.start) else None) / of,
        per_text(same) / of, distinct / of, top / of, lines / of, distinct_lines / line_of,
        np.bincount(lw.owner, weights=line_length, minlength=n)[:n] / line_of, np.bincount(lw.owner, weights=line_length < 20, minlength=n)[:n] / line_of,
    ]
    out = np.stack(columns, axis=1)
    out[size == 0] = 0
    return out


def _groups(owner: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of different keys, size of the largest group) per owner."""
    if not len(key):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((key, owner))
    o, k = owner[order], key[order]
    new = np.concatenate([[True], (o[1:] != o[:-1]) | (k[1:] != k[:-1])])
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(o)))
    largest = np.zeros(n)
    np.maximum.at(largest, o[at], counts)
    return np.bincount(o[at], minlength=n)[:n].astype(float), largest


@dataclass(frozen=True)
class Forest:
    """Complete trees of one depth as arrays [tree, node]; node i has children 2i+1 and 2i+2."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    start: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row."""
        trees = np.arange(len(self.feature))[None, :]
        node = np.zeros((len(x), len(self.feature)), np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.cut[trees, node])
        margin = self.start + self.leaf[trees, node - (2**self.depth - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-margin))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, penalty: float = 1.0, least: float = 5.0) -> Forest:
    """Newton boosting of the logistic loss; each level's splits come from one histogram of all its nodes.

    Without rows the forest says 0.5; with one label only it says nearly that label.
    """
    n, width = x.shape
    nodes = 2**depth - 1
    feature, cut = np.zeros((trees, nodes), np.int64), np.full((trees, nodes), np.inf)
    leaf = np.zeros((trees, nodes + 1))
    if not n:
        return Forest(feature, cut, leaf, 0.0, depth)
    share = (y.sum() + 0.5) / (n + 1)
    start = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    codes = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    flat = codes + np.arange(width) * bins
    margin = np.full(n, start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            key = ((node - first)[:, None] * (width * bins) + flat).ravel()
            sums = [np.bincount(key, weights=np.repeat(v, width), minlength=count * width * bins).reshape(count, width, bins) for v in (g, h)]
            left_g, left_h = (s.cumsum(axis=2)[:, :, :-1] for s in sums)
            all_g, all_h = (s.sum(axis=2)[:, :1, None] for s in sums)
            right_g, right_h = all_g - left_g, all_h - left_h
            gain = left_g**2 / (left_h + penalty) + right_g**2 / (right_h + penalty) - all_g**2 / (all_h + penalty)
            gain[(left_h < least) | (right_h < least)] = 0
            for f, e in enumerate(edges):
                gain[:, f, len(e):] = 0
            best = gain.reshape(count, -1).argmax(axis=1)
            f, b = best // (bins - 1), best % (bins - 1)
            good = gain.reshape(count, -1)[np.arange(count), best] > 1e-6
            feature[t, first : first + count] = np.where(good, f, 0)
            cut[t, first : first + count] = [edges[i][j] if ok else np.inf for i, j, ok in zip(f, b, good)]
            at = node
            node = 2 * at + 1 + (x[np.arange(n), feature[t, at]] > cut[t, at])
        place = node - nodes
        sum_g, sum_h = (np.bincount(place, weights=v, minlength=nodes + 1) for v in (g, h))
        leaf[t] = rate * sum_g / (sum_h + penalty)
        margin += leaf[t, place]
    return Forest(feature, cut, leaf, start, depth)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Rows that labels are never learned from; a null id has no label and is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 20_000, **growth) -> Forest:
    """Forest from at most ``max_rows`` labelled documents outside the held-out fold, chosen by a hash of their ids.

    Rows without id or label are left out; of several labels of one document the larger counts.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(label).alias("label"))
    n = known.count()
    chosen = known.withColumn("_turn", F.xxhash64("doc_id"))
    if n > max_rows:
        # Spare rows, as some labels may have no document; then exactly max_rows of the documents found.
        chosen = chosen.where(F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(1 << 30)) < int((1 << 30) * 1.2 * max_rows / n))
    # About 1.2 * max_rows rows of three numbers: a bounded broadcast.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = statistics(text_bytes(batch.column(0)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            return pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), lists], ["label", "turn", "x"])

        return step

    rows = rows.select("text", F.col("label").cast("double"), F.col("_turn").alias("turn"))
    sample = map_texts(rows, "text", "label double, turn long, x array<double>", make)
    found = sample.orderBy("turn", "label", "x").limit(max_rows).toArrow()
    x = found["x"].combine_chunks().flatten().to_numpy().reshape(-1, len(STATISTICS)) if found.num_rows else np.zeros((0, len(STATISTICS)))
    return grow(x, found["label"].to_numpy().astype(float), **growth)


def classify(docs: DataFrame, forest: Forest, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on); columns of these names are replaced.

    A null text scores as the empty one. One row per row; an empty table stays empty.
    """
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    inner = [f"c{i}" for i in range(len(names))]
    at = names.index(text)
    kinds = ", ".join(f"{c} {docs.schema[n].dataType.simpleString()}" for c, n in zip(inner, names))

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            p = forest.score(statistics(text_bytes(batch.column(at))))
            columns = [*batch.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))]
            return pa.RecordBatch.from_arrays(columns, [*inner, "score", "predicted"])

        return step

    return map_texts(docs.select(*names).toDF(*inner), inner[at], kinds + ", score double, predicted int", make).toDF(*names, "score", "predicted")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the labels outside the held-out fold."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    forest = train(docs, read(spark, sf_dir, "labels", "doc_id", "quality"))
    scored = classify(docs, forest)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


QUERIES = {"op6_quality": op6_quality}
#: A learned model; tests/llm measures it on the held-out fold.
ORACLE_SQL: dict[str, str] = {}
