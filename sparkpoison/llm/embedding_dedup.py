"""Embedding near-duplicates: cross-polytope hashing, multiprobe buckets, verified pairs.

A vector is turned by three rounds of random signs and a Hadamard transform, which takes
d log d additions, and hashed to the nearest corner of the cross-polytope: its largest
coordinate and that one's sign. Several such hashes make a bucket, several tables of buckets
make it likely that near vectors meet, and a vector also enters the buckets that it nearly
fell into. Inside a bucket all pairs are compared by cosine in double precision; a pair that
meets more than once is counted where it meets first.

Equal vectors are one weighted vector from the start. A bucket with more than BLOCK members
is a grid of blocks; a task holds two at a time and returns counts and local components,
never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkpoison.llm.common import map_cells, read, small_batches
from sparkpoison.llm.words import mix
from sparkpoison.operators.clustering import connected_components
from sparkpoison.session import broadcast_if_small, checkpoint

#: members of a bucket that cost no more to compare, all with all, than to hash once more
_CROWD = 256
#: members of one block of a bucket, and pairs whose first meeting is looked up at once
BLOCK, _PAIRS = 8192, 200_000
#: members of a cell that is solved together with others, and pairs of such cells compared at once
_SMALL, _SMALL_PAIRS = 64, 50_000


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Hadamard matrix times columns; the number of rows is a power of two."""
    step = 1
    while step < len(x):
        pairs = x.reshape(-1, 2, step, x.shape[1])
        x = np.empty_like(pairs)
        np.add(pairs[:, 0], pairs[:, 1], out=x[:, 0])
        np.subtract(pairs[:, 0], pairs[:, 1], out=x[:, 1])
        x = x.reshape(-1, pairs.shape[3])
        step *= 2
    return x


def rotate(x: np.ndarray, seed: int) -> np.ndarray:
    """Three rounds of random signs and Hadamard transform, the same for a seed everywhere."""
    x = np.ascontiguousarray(x.T)  # steps run along the vectors
    size = len(x)
    for turn in range(3):
        bits = mix(np.arange(size, dtype=np.uint64) + np.uint64((seed * 3 + turn) << 20)) & np.uint64(1)
        x = hadamard(x * (1.0 - 2.0 * bits.astype(float))[:, None]) / math.sqrt(size)
    return np.ascontiguousarray(x.T)


def buckets(x: np.ndarray, tables: int, hashes: int, probes: int) -> np.ndarray:
    """[vector, table, probe] bucket numbers of unit vectors: the own bucket first, then the nearest others."""
    n, d = x.shape
    size = 1 << max(1, (d - 1).bit_length())
    padded = np.zeros((n, size))
    padded[:, :d] = x
    rows = np.arange(n)
    out = np.zeros((n, tables, probes), np.uint64)
    for t in range(tables):
        best, second, loss = [], [], []
        for k in range(hashes):
            y = rotate(padded, t * hashes + k)
            value = np.abs(y)
            one = value.argmax(axis=1)
            top = value[rows, one]
            value[rows, one] = -1.0
            two = value.argmax(axis=1)
            best.append(one + size * (y[rows, one] < 0))
            second.append(two + size * (y[rows, two] < 0))
            loss.append(top - value[rows, two])
        # Probes change the hashes whose second corner is nearest: one of them, then two, ...
        order = np.argsort(np.stack(loss, axis=1), axis=1)
        changes = sorted(range(1 << hashes), key=lambda m: (sum((i + 1) for i in range(hashes) if m >> i & 1), m))[:probes]
        for p, change in enumerate(changes):
            number = np.full(n, t + 1, np.uint64)
            swapped = np.zeros((n, hashes), bool)
            for i in range(hashes):
                if change >> i & 1:
                    swapped[np.arange(n), order[:, i]] = True
            with np.errstate(over="ignore"):
                for k in range(hashes):
                    corner = np.where(swapped[:, k], second[k], best[k]).astype(np.uint64)
                    number = number * np.uint64(4 * size + 1) + corner + np.uint64(1)
            out[:, t, p] = number
    return out


def choose_hashes(n: int, d: int) -> int:
    """Hashes of a table after which a bucket of ``n`` vectors holds _CROWD of them on average, or fewer."""
    corners = 2 << max(1, (d - 1).bit_length())
    return max(1, math.ceil(math.log(max(n, 1) / _CROWD) / math.log(corners)))


def choose_tables(d: int, cosine: float, hashes: int, probes: int, miss: float = 1e-4, pairs: int = 2000) -> int:
    """Tables after which a pair at the cosine limit has met with probability 1 - miss, from made-up pairs of that cosine."""
    rng = np.random.default_rng(d)
    a, b = rng.normal(size=(2, pairs, max(d, 2)))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    near = cosine * a + math.sqrt(max(0.0, 1 - cosine**2)) * b
    trial = 4
    x, y = (buckets(v, trial, hashes, probes) for v in (a, near))
    met = (x[:, :, :, None] == y[:, :, None, :]).any(axis=(2, 3)).mean()
    return max(1, math.ceil(math.log(miss) / math.log(max(1e-12, 1 - min(met, 0.999)))))


def _unit(column: pa.Array) -> np.ndarray:
    """Rows of a list column, all of one length, scaled to length 1."""
    x = column.flatten().to_numpy().astype(float).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no square overflows
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _by_length(column: pa.Array) -> Iterator[np.ndarray]:
    """Row numbers of the vectors of one dimension."""
    sizes = column.value_lengths().to_numpy()
    for d in np.unique(sizes):
        yield np.flatnonzero(sizes == d)


def _hashed(classes: DataFrame, plan: dict[int, tuple[int, int]], probes: int) -> DataFrame:
    """(rep, keys): the buckets of every class; ``plan`` gives tables and hashes per dimension."""
    kind = classes.schema["rep"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column(2).to_numpy().view(np.uint64)
            for rows in _by_length(batch.column(1)):
                part = batch.take(pa.array(rows))
                x = _unit(part.column(1))
                tables, hashes = plan[x.shape[1]]
                keys = mix(buckets(x, tables, hashes, probes).reshape(len(rows), -1) ^ mix(labels[rows] + np.uint64(x.shape[1]))[:, None])
                heads = pa.array(np.arange(len(rows) + 1) * keys.shape[1], pa.int32())
                lists = pa.ListArray.from_arrays(heads, pa.array(np.ascontiguousarray(keys).view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["rep", "keys"])

    return classes.select("rep", "embedding", "lh").mapInArrow(run, f"rep {kind}, keys array<long>")


def _first_here(keys: np.ndarray, key: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether row i's bucket ``key`` is the smallest of those that a pair shares in the first table where it meets."""
    out, rest = np.zeros(len(i), bool), np.arange(len(i))
    for t in range(keys.shape[1]):  # most pairs share a bucket of the first tables and are settled there
        later = []
        for lo in range(0, len(rest), _PAIRS):
            at = rest[lo : lo + _PAIRS]
            a, b = keys[i[at], t], keys[j[at], t]
            shared = (a[:, :, None] == b[:, None, :]).any(axis=2)
            met = shared.any(axis=1)
            low = np.where(shared, a, np.iinfo(np.int64).max).min(axis=1)
            out[at[met]] = (low == key[i[at]])[met]
            later.append(at[~met])
        if not later:
            break
        rest = np.concatenate(later)
    return out


def _join(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``root``, the number of the smallest row reachable so far, after the links i - j."""
    while True:
        a, b = root[i], root[j]
        open_ = a != b
        if not open_.any():
            return root
        np.minimum.at(root, np.maximum(a, b)[open_], np.minimum(a, b)[open_])
        while not np.array_equal(root, root[root]):
            root = root[root]


class _Rows:
    """Members of one or several cells, sorted by cell and class."""

    def __init__(self, table: pa.Table, cosine: float, probes: int):
        self.cosine = cosine
        self.key, self.at, self.copies = (table[c].to_numpy() for c in ("key", "at", "copies"))
        self.cross = table["i"].to_numpy() != table["j"].to_numpy()
        self.x = _unit(table["embedding"].combine_chunks())
        self.keys = table["keys"].combine_chunks().flatten().to_numpy().reshape(len(table), -1, probes)

    def in_cell(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (i < j) at or above the cosine, all rows being one cell."""
        n = len(self.x)
        step = max(1, 4_000_000 // n)
        for lo in range(0, n, step):
            i, j = np.nonzero(self.x[lo : lo + step] @ self.x.T >= self.cosine)
            i += lo
            ok = (i < j) & (~self.cross[i] | (self.at[i] != self.at[j]))
            yield i[ok], j[ok]

    def in_cells(self, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (i < j) at or above the cosine inside small cells of these sizes, without a step per cell."""
        later = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(self.x)) - 1  # rows of the cell behind a row
        for lo, hi in _spans(later, _SMALL_PAIRS):
            many = later[lo:hi]
            i = np.repeat(np.arange(lo, hi), many)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)
            ok = ~self.cross[i] | (self.at[i] != self.at[j])
            i, j = i[ok], j[ok]
            near = np.einsum("ij,ij->i", self.x[i], self.x[j]) >= self.cosine
            yield i[near], j[near]

    def result(self, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """(links first met here, number of the smallest member that is reachable here) of every member."""
        n = len(self.x)
        count, root = np.zeros(n), np.arange(n)
        for i, j in links:
            new = _first_here(self.keys, self.key, i, j)
            count += np.bincount(i[new], weights=self.copies[j[new]], minlength=n) + np.bincount(j[new], weights=self.copies[i[new]], minlength=n)
            root = _join(root, i, j)  # only what still joins something is kept for the components
        return count.astype(np.int64), root


def _spans(weights: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose weights add up to about ``most``."""
    ends, lo = np.cumsum(weights), 0
    while lo < len(weights):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")))
        yield lo, hi
        lo = hi


def _compare(members: DataFrame, cosine: float, probes: int) -> DataFrame:
    """(u, v, n): links of class u first met in a cell, and v, the smallest class reachable from u in that cell.

    Most cells hold two or three classes, so the small cells of an Arrow batch are solved together.
    """
    kind = members.schema["rep"].dataType.simpleString()

    def solve(table: pa.Table) -> pa.RecordBatch:
        names = ["key", "i", "j"]
        table = table.take(pa.compute.sort_indices(table, sort_keys=[(c, "ascending") for c in (*names, "rep")])).combine_chunks()
        at = np.stack([table[c].to_numpy().astype(np.int64) for c in names])
        starts = np.flatnonzero(np.r_[True, (at[:, 1:] != at[:, :-1]).any(axis=0)])
        sizes = np.diff(np.r_[starts, len(table)])
        width = table["embedding"].combine_chunks().value_lengths().to_numpy()[starts]
        count, root = np.zeros(len(table), np.int64), np.arange(len(table))
        small = sizes <= _SMALL
        for lo, n in zip(starts[~small], sizes[~small]):
            cell = _Rows(table.slice(lo, n), cosine, probes)
            count[lo : lo + n], held = cell.result(cell.in_cell())
            root[lo : lo + n] = held + lo
        for d in np.unique(width[small]):
            rows = np.flatnonzero(np.repeat(small & (width == d), sizes))
            cells = _Rows(table.take(pa.array(rows)), cosine, probes)
            count[rows], held = cells.result(cells.in_cells(sizes[small & (width == d)]))
            root[rows] = rows[held]
        rep = table["rep"].combine_chunks()
        return pa.RecordBatch.from_arrays([rep, rep.take(pa.array(root)), pa.array(count)], ["u", "v", "n"])

    return map_cells(members, ["key", "i", "j"], f"u {kind}, v {kind}, n long", solve, several=True)


def near_duplicates(
    vectors: DataFrame,
    cosine: float = 0.98,
    probes: int = 2,
    miss: float = 1e-4,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row; only vectors of equal, non-null label and dimension compare.

    A null or zero vector, or one with a null or non-finite component, links with nothing; so does a row without
    label or id (component null and not kept without id). Repeated rows are one vector and repeat in the result; an
    id with several vectors is one node that counts the links of all of them to other ids. A link at the cosine limit is missed with probability
    ``miss`` at most on average, nearer ones less; none below the limit is given. Other columns are not read.
    """
    small_batches(vectors.sparkSession)
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"), F.col(label).alias("label"))
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("ok", F.coalesce(good, F.lit(False)) & F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    rows = rows.withColumns({"h1": F.when(F.col("ok"), F.xxhash64("label", "embedding")), "h2": F.when(F.col("ok"), F.xxhash64(F.lit(1), "label", "embedding"))})
    valid = rows.where("ok")
    copies = valid.select("h1", "h2", "vec_id").distinct().groupBy("h1", "h2").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"))
    shown = valid.groupBy("h1", "h2").agg(F.first("embedding").alias("embedding"), F.first(F.xxhash64("label")).alias("lh"))
    classes = checkpoint(copies.join(shown, ["h1", "h2"]).withColumn("rep", F.monotonically_increasing_id()))  # a class's number
    sizes = classes.groupBy("lh", F.size("embedding").alias("d")).agg(F.count("*").alias("n")).groupBy("d").agg(F.max("n").alias("n")).collect()  # a row per dimension
    plan = {}
    for r in sizes:
        hashes = choose_hashes(r["n"], r["d"])
        plan[r["d"]] = (choose_tables(r["d"], cosine, hashes, probes, miss), hashes)
    keys = checkpoint(_hashed(classes, plan, probes))
    entries = keys.select("rep", F.explode(F.array_distinct("keys")).alias("key"))
    crowded = entries.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("g"))
    met = entries.join(crowded, "key").withColumn("at", F.pmod(F.xxhash64("rep"), F.col("g")).cast("int"))
    cells = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    cells = cells.select("rep", "key", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), "at")
    carried = classes.select("rep", "copies", "embedding").join(keys, "rep")
    cells = cells.join(carried, "rep").select("key", "i", "j", "rep", "at", "copies", "embedding", "keys")
    found = checkpoint(_compare(cells, cosine, probes))
    counts = found.groupBy("u").agg(F.sum("n").alias("n")).withColumnRenamed("u", "rep")
    counted = classes.join(counts, "rep", "left").select("h1", "h2", "rep", "low", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"))
    edges = found.where("u <> v").select("u", "v").distinct()
    # Classes of one id are one node: joined here, their links added up, those among themselves taken off.
    ends = [f(h).alias(f"{f.__name__}_{h}") for h in ("h1", "h2") for f in (F.min, F.max)]
    several = checkpoint(valid.groupBy("vec_id").agg(*ends).where("min_h1 < max_h1 OR min_h2 < max_h2").select("vec_id"))
    shared = not several.isEmpty()
    if shared:
        several = broadcast_if_small(several)
        own = checkpoint(valid.join(several, "vec_id").select("vec_id", "h1", "h2").distinct().join(classes.select("h1", "h2", "rep", "lh", "embedding"), ["h1", "h2"]))
        first = own.groupBy("vec_id").agg(F.min("rep").alias("u"))
        edges = edges.union(own.join(first, "vec_id").where("u <> rep").select("u", F.col("rep").alias("v")).distinct())
        totals = own.join(counted.select("rep", "n"), "rep").groupBy("vec_id").agg(F.sum("n").alias("total"))
        totals = checkpoint(totals.join(_among(own, cosine), "vec_id", "left").select("vec_id", (F.col("total") - F.coalesce("among", F.lit(0))).alias("_total")))
    parts = checkpoint(connected_components(edges).withColumnRenamed("node", "rep"))
    lowest = parts.join(classes.select("rep", "low"), "rep").groupBy("component").agg(F.min("low").alias("lowest"))
    named = counted.join(parts.join(lowest, "component"), "rep", "left")
    named = named.select("h1", "h2", F.col("n").alias("_n"), F.coalesce("lowest", "low").alias("_c"))
    out = rows.select("vec_id", "h1", "h2").join(named, ["h1", "h2"], "left")
    if shared:
        out = out.join(broadcast_if_small(totals), "vec_id", "left").withColumn("_n", F.when(F.col("_n").isNotNull(), F.coalesce("_total", "_n")))
    component = F.coalesce("_c", "vec_id")
    return out.select(
        "vec_id", F.coalesce("_n", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


def _among(own: DataFrame, cosine: float) -> DataFrame:
    """(vec_id, among): links, counted at both ends, between different vectors of one id."""
    most = F.array_max(F.transform("embedding", lambda x: F.abs(x)))
    scaled = own.withColumn("most", most).withColumn("x", F.transform("embedding", lambda x: x / F.col("most")))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    unit = scaled.withColumn("norm", F.sqrt(dot("x", "x"))).select("vec_id", "lh", "rep", F.transform("x", lambda x: x / F.col("norm")).alias("x"))
    a, b = (unit.select("vec_id", "lh", F.col("rep").alias(f"{s}r"), F.col("x").alias(f"{s}x")) for s in "ab")
    pairs = a.join(b, ["vec_id", "lh"]).where((F.col("ar") != F.col("br")) & (F.size("ax") == F.size("bx")))
    return pairs.where(dot("ax", "bx") >= cosine).groupBy("vec_id").agg(F.count("*").alias("among"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates of every vector within its label."""
    return near_duplicates(read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


QUERIES = {"op2_embedding_dedup": op2_embedding_dedup}

ORACLE_SQL = {"op2_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), ok AS (SELECT * FROM v WHERE label IS NOT NULL AND list_dot_product(e, e) > 0),
links AS MATERIALIZED (
  SELECT a.vec_id AS u, b.vec_id AS v FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach(u, v) AS (
  SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u
), low AS (SELECT u, min(v) AS m FROM reach GROUP BY u), n AS (SELECT u, count(*) AS k FROM links GROUP BY u)
SELECT vec_id, coalesce(k, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id,
  vec_id <= coalesce(m, vec_id) AS kept
FROM v LEFT JOIN low ON low.u = vec_id LEFT JOIN n ON n.u = vec_id
"""}
