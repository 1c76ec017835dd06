"""Exact top-k inner products by best-first search in M-trees.

A vector c gets one more component, sqrt(M - |c|^2) with M the largest squared norm, and a query a zero: then
|q' - c'|^2 = |q|^2 + M - 2 <q, c>, so the largest inner products are the nearest points of a metric space. Vectors
are dealt to cells by their nearest sampled pivot, each run of at most ``TREE`` vectors of a cell becomes a tree, and a
tree's pages are rows of a checkpointed table: an entry holds its pivot or vector, its covering radius, its distance
to the parent's pivot and the smallest id below it. A query first searches the tree whose root promises most, which
gives it a score to beat; then all trees, pages and entries whose bound beats that score. |d(q, parent) - d(entry,
parent)| - radius bounds an entry before its own distance is computed. Bounds only prune; scores are exact integers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from sparkpoison.llm.common import read, small_batches
from sparkpoison.session import BROADCAST_BYTES, broadcast_if_small, checkpoint

#: entries of a page, vectors of a tree, vectors a cell should hold, queries searched together, roots compared together
PAGE, TREE, CELL, BLOCK, ROOTS = 64, 16_384, 4096, 1024, 4096
#: pages a query visits one after the other, best first, before the rest is visited page by page for all queries
_ROUNDS = 3
#: places of row keys: a tree's number, then the vector's place in it
_SHIFT = 24
_NONE = np.iinfo(np.int64)

_PAGES = (
    "cell bigint, page int, leaf boolean, dims int, lowest bigint, pivot binary, radius double, ids binary, "
    "vectors binary, rows binary, asks binary, to_parent binary, children binary, radii binary"
)


def quantised(vectors: DataFrame, scale: int, vec_id: str, embedding: str, asks: Column) -> DataFrame:
    """(vec_id, asks, v, dims, norm) of the vectors that take part: v = floor(scale * x) as whole numbers."""
    rows = vectors.select(F.col(f"`{vec_id}`").cast("bigint").alias("vec_id"), F.coalesce(asks, F.lit(False)).alias("asks"), F.col(f"`{embedding}`").alias("e"))
    finite = F.expr("forall(e, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf'))")
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("e").isNotNull()).where(finite)
    rows = rows.select("vec_id", "asks", F.expr(f"transform(e, x -> floor({scale} * CAST(x AS double)))").alias("v"))
    norm = F.expr("aggregate(v, 0D, (s, x) -> s + CAST(x AS double) * x)")
    return rows.select("vec_id", "asks", "v", F.size("v").alias("dims"), norm.alias("norm")).where(F.col("norm") < float(1 << 62))


def lengths(v: np.ndarray, most: float) -> np.ndarray:
    """Vectors with the component that lets inner products be read off distances."""
    v = v.astype(np.float64)
    return np.hstack([v, np.sqrt(np.maximum(most - (v * v).sum(axis=1), 0))[:, None]])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def packed(v: np.ndarray) -> bytes:
    """Whole numbers in the fewest bytes that hold all of them."""
    most = int(np.abs(v).max(initial=0))
    return v.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64).tobytes()


def unpacked(content: bytes, n: int, dims: int) -> np.ndarray:
    width = len(content) // (n * dims) if n * dims else 8
    return np.frombuffer(content, f"<i{width}").reshape(n, dims).astype(np.int64)


def _parts(place: np.ndarray, point: np.ndarray, pivot: np.ndarray) -> list[np.ndarray]:
    """Divide a page's rows among children: to the nearest of spread seeds; a child too large is cut by its distance."""
    n = len(place)
    seeds = point[place[np.linspace(0, n - 1, min(PAGE, -(-n // PAGE)) + 1).astype(np.int64)]]
    to_seeds = distances(point[place], seeds)
    nearest = to_seeds.argmin(axis=1)
    out = []
    for s in np.unique(nearest):
        mine = nearest == s
        group = place[mine]
        if 2 * len(group) > n:
            order = np.argsort(to_seeds[mine, s], kind="stable")
            out += [np.sort(g) for g in np.array_split(group[order], max(2, min(PAGE // 2, -(-len(group) // PAGE))))]
        else:
            out.append(group)
    return out


def grow(v: np.ndarray, ids: np.ndarray, asks: np.ndarray, most: float, tree: int) -> list[dict]:
    """Pages of the tree over vectors in the order of their ids; page 0 is the root."""
    point, pages = lengths(v, most), []

    def middle(place: np.ndarray) -> np.ndarray:
        return point[place[((point[place] - point[place].mean(axis=0)) ** 2).sum(axis=1).argmin()]]

    waiting = [(np.arange(len(v)), middle(np.arange(len(v))))]
    pages.append({})
    for number, (place, pivot) in enumerate(waiting):  # grows while it is read
        from_pivot = distances(point[place], pivot[None])[:, 0]
        page = {
            "cell": tree, "page": number, "leaf": len(place) <= PAGE, "dims": v.shape[1], "lowest": int(ids[place[0]]),
            "pivot": pivot.tobytes(), "radius": float(from_pivot.max()), "rows": b"", "asks": b"", "children": b"", "radii": b"",
        }
        if page["leaf"]:
            page |= {"ids": ids[place].tobytes(), "vectors": packed(v[place]), "to_parent": from_pivot.tobytes()}
            page |= {"rows": ((tree << _SHIFT) + place).tobytes(), "asks": asks[place].astype(np.uint8).tobytes()}
        else:
            groups = _parts(place, point, pivot)
            pivots = np.stack([middle(g) for g in groups])
            radii = np.array([distances(point[g], p[None]).max() for g, p in zip(groups, pivots)])
            first = len(waiting)
            waiting += list(zip(groups, pivots))
            page |= {"ids": ids[[g[0] for g in groups]].tobytes(), "vectors": pivots.tobytes(), "radii": radii.tobytes()}
            page |= {"to_parent": distances(pivots, pivot[None])[:, 0].tobytes(), "children": np.arange(first, len(waiting), dtype=np.int64).tobytes()}
            pages += [{}] * len(groups)
        pages[number] = page
    return pages


def index(rows: DataFrame) -> tuple[DataFrame, float]:
    """(pages of all trees, largest squared norm); every row is in one leaf."""
    spark = rows.sparkSession
    small_batches(spark)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n, most, dims = rows.agg(F.count("*"), F.max("norm"), F.max("dims")).first()
    most = float(most or 0)
    cells = max(1, min(-(-n // CELL), BROADCAST_BYTES // (8 * ((dims or 0) + 1))))
    # the pivots are a sample, of which the bytes are bounded; all vectors are dealt to them
    sample = rows.select("v", F.xxhash64("vec_id", "v").alias("h")).orderBy("h", "vec_id").limit(cells).select("v").distinct().collect()
    pivots: dict[int, np.ndarray] = {}
    for r in sorted((r["v"] for r in sample), key=len):
        pivots.setdefault(len(r), []).append(r)
    pivots = {d: lengths(np.array(p, np.int64).reshape(len(p), d), most) for d, p in pivots.items()}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(3).to_numpy()
            for d in np.unique(dims).tolist():
                here = batch.filter(pa.array(dims == d))
                v = here.column(2).flatten().to_numpy().reshape(here.num_rows, d)
                cell = np.zeros(here.num_rows, np.int64)
                if d in pivots:
                    step = max(1, (1 << 22) // len(pivots[d]))
                    cell = np.concatenate([distances(lengths(v[i : i + step], most), pivots[d]).argmin(axis=1) for i in range(0, len(v), step)])
                yield pa.RecordBatch.from_arrays(
                    [here.column(0), here.column(1), pa.array([packed(x) for x in v], pa.binary()), here.column(3), pa.array(cell, pa.int64())],
                    ["vec_id", "asks", "v", "dims", "at"],
                )

    dealt = rows.select("vec_id", "asks", "v", "dims").mapInArrow(deal, "vec_id bigint, asks boolean, v binary, dims int, at bigint")
    order = ["dims", "at", "vec_id"]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: list[pa.RecordBatch] = []
        kind, trees = None, 0

        def plant() -> pa.RecordBatch:
            nonlocal trees
            table = pa.Table.from_batches(held).combine_chunks()
            d = kind[0]
            v = np.concatenate([unpacked(x.as_py(), 1, d) for x in table.column("v")])
            tree = (TaskContext.get().partitionId() << 20) + trees
            trees += 1
            pages = grow(v, table.column("vec_id").to_numpy(), table.column("asks").to_numpy(zero_copy_only=False), most, tree)
            return pa.RecordBatch.from_pydict({c.split()[0]: [p[c.split()[0]] for p in pages] for c in _PAGES.split(", ")}, schema=_arrow())

        for batch in batches:
            at = np.stack([batch.column(3).to_numpy().astype(np.int64), batch.column(4).to_numpy()])
            cuts = [0, *(np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                here = tuple(at[:, lo].tolist())
                while lo < hi:
                    room = TREE - sum(b.num_rows for b in held)
                    if held and (here != kind or not room):
                        yield plant()
                        held, room = [], TREE
                    kind = here
                    held.append(batch.slice(lo, min(hi - lo, room)))
                    lo += held[-1].num_rows
        if held:
            yield plant()

    ranged = dealt.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    return checkpoint(ranged.mapInArrow(build, _PAGES)), most


def _arrow() -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary()}
    return pa.schema([(c, kinds[k]) for c, k in (c.split() for c in _PAGES.split(", "))])


class Best:
    """The k best (score, id) of every query so far, ties to the smaller id; what cannot beat the worst is pruned."""

    def __init__(self, scores: np.ndarray, ids: np.ndarray, k: int):
        self.k = k
        self.scores, self.ids = np.repeat(scores[:, None], k, axis=1), np.repeat(ids[:, None], k, axis=1)
        self.found = np.zeros((len(scores), k), bool)

    def beats(self, queries: np.ndarray, bound: np.ndarray, lowest: np.ndarray) -> np.ndarray:
        """Whether a score of at most ``bound`` of an id of at least ``lowest`` may enter; rows are queries."""
        worst, last = self.scores[queries, -1], self.ids[queries, -1]
        if bound.ndim == 2:
            worst, last, lowest = worst[:, None], last[:, None], lowest[None, :]
        return (bound > worst) | ((bound == worst) & (lowest < last))

    def take(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray, usable: np.ndarray) -> None:
        better = usable & self.beats(queries, scores, ids)
        some = np.flatnonzero(better.any(axis=1))
        if not len(some):
            return
        q = queries[some]
        all_scores = np.hstack([self.scores[q], np.where(better[some], scores[some], _NONE.min)])
        all_ids = np.hstack([self.ids[q], np.where(better[some], ids[None, :], _NONE.max)])
        all_found = np.hstack([self.found[q], better[some]])
        # scores are above the least long, so they can be negated
        order = np.lexsort((all_ids, -np.maximum(all_scores, -_NONE.max)), axis=1)[:, : self.k]
        pick = lambda x: np.take_along_axis(x, order, axis=1)
        self.scores[q], self.ids[q], self.found[q] = pick(all_scores), pick(all_ids), pick(all_found)


class Search:
    """One block of queries in one tree."""

    def __init__(self, pages: pa.Table, q: np.ndarray, keys: np.ndarray, best: Best, most: float):
        self.pages = {p["page"]: p for p in pages.to_pylist()}
        self.q, self.keys, self.best, self.most = q, keys, best, most
        self.point = np.hstack([q.astype(np.float64), np.zeros((len(q), 1))])
        self.square = (self.point**2).sum(axis=1) + most
        self.exact = (self.square.max(initial=0) + most) < 2.0**52
        self.work = 0

    def bound(self, queries: np.ndarray, nearest: np.ndarray) -> np.ndarray:
        """The largest score of a point at distance ``nearest`` or more; whole, with room for rounding."""
        square = self.square[queries] if nearest.ndim == 1 else self.square[queries][:, None]
        return highest(square, nearest, self.q.shape[1])

    def run(self) -> None:
        d = len(self.q[0]) + 1
        root = self.pages[0]
        everyone = np.arange(len(self.q))
        leaves: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        waiting = [(0, everyone, distances(self.point, np.frombuffer(root["pivot"])[None])[:, 0])]
        while waiting:
            number, queries, from_pivot = waiting.pop()
            page = self.pages[number]
            up = self.bound(queries, from_pivot - page["radius"])
            use = self.best.beats(queries, up, np.int64(page["lowest"]))
            if page["leaf"]:
                leaves.append((number, queries[use], from_pivot[use], up[use]))
                continue
            queries, from_pivot = queries[use], from_pivot[use]
            lowest, radii = np.frombuffer(page["ids"], np.int64), np.frombuffer(page["radii"])
            before = np.abs(from_pivot[:, None] - np.frombuffer(page["to_parent"])[None, :]) - radii[None, :]
            open_ = self.best.beats(queries, self.bound(queries, before), lowest)
            some, children = open_.any(axis=1), open_.any(axis=0)
            if not some.any():
                continue
            pivots, numbers = np.frombuffer(page["vectors"]).reshape(-1, d)[children], np.frombuffer(page["children"], np.int64)[children]
            queries, open_ = queries[some], open_[some][:, children]
            to_child = distances(self.point[queries], pivots)
            self.work += to_child.size
            open_ &= self.best.beats(queries, self.bound(queries, to_child - radii[children][None, :]), lowest[children])
            for c, child in enumerate(numbers.tolist()):
                if open_[:, c].any():
                    waiting.append((child, queries[open_[:, c]], to_child[open_[:, c], c]))
        self._visit_all(leaves)

    def _visit_all(self, leaves: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> None:
        if not leaves:
            return
        number = np.repeat([n for n, *_ in leaves], [len(q) for _, q, *_ in leaves])
        queries, from_pivot, up = (np.concatenate([leaf[i] for leaf in leaves]) for i in (1, 2, 3))
        lowest = np.repeat([self.pages[n]["lowest"] for n, *_ in leaves], [len(q) for _, q, *_ in leaves])
        order = np.lexsort((lowest, -up, queries))
        number, queries, from_pivot, up, lowest = (x[order] for x in (number, queries, from_pivot, up, lowest))
        heads = np.flatnonzero(np.diff(queries, prepend=-1))
        rank = np.arange(len(queries)) - np.repeat(heads, np.diff(np.append(heads, len(queries))))
        # best first: each query's most promising pages, then what still promises to beat them
        for turn in range(_ROUNDS + 1):
            now = rank == turn if turn < _ROUNDS else rank >= _ROUNDS
            now = np.flatnonzero(now)
            now = now[self.best.beats(queries[now], up[now], lowest[now])]
            now = now[np.argsort(number[now], kind="stable")]
            cuts = np.flatnonzero(np.diff(number[now], prepend=-1))
            blocks = np.split(now, cuts[1:]) if len(now) else []
            for block in sorted(blocks, key=lambda b: -up[b].max()):
                self._visit(int(number[block[0]]), queries[block], from_pivot[block], up[block])

    def _visit(self, number: int, queries: np.ndarray, from_pivot: np.ndarray, up: np.ndarray) -> None:
        page = self.pages[number]
        use = self.best.beats(queries, up, np.int64(page["lowest"]))
        queries, from_pivot = queries[use], from_pivot[use]
        ids = np.frombuffer(page["ids"], np.int64)
        near = np.abs(from_pivot[:, None] - np.frombuffer(page["to_parent"])[None, :])
        open_ = self.best.beats(queries, self.bound(queries, near), ids)
        some, entries = open_.any(axis=1), open_.any(axis=0)
        if not some.any():
            return
        queries, ids = queries[some], ids[entries]
        rows = np.frombuffer(page["rows"], np.int64)[entries]
        v = unpacked(page["vectors"], len(entries), self.q.shape[1])[entries]
        if self.exact:  # all sums are whole numbers below 2 ** 53
            scores = (self.point[queries, :-1] @ v.T.astype(np.float64)).astype(np.int64)
        else:
            scores = self.q[queries] @ v.T
        self.work += scores.size
        self.best.take(queries, scores, ids, self.keys[queries][:, None] != rows[None, :])


def highest(square: np.ndarray, nearest: np.ndarray, dims: int) -> np.ndarray:
    """Bound on the inner product of a query with |q|^2 + M = ``square`` and a point at distance ``nearest`` or more.

    A squared distance is a sum of dims + 1 rounded products; three distances may be in error in ``nearest``.
    """
    rounding = np.sqrt(4.4e-16 * (dims + 16) * square)
    raw = (square - np.maximum(nearest - 3 * rounding, 0) ** 2) / 2
    return np.clip(np.floor(raw + 1e-6 + 1e-14 * square), -(2.0**62), 2.0**62).astype(np.int64)


def _queries(pages: DataFrame) -> DataFrame:
    """(key, query_id, dims, q): the rows that ask, from the leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.to_pylist():
                asks = np.frombuffer(p["asks"], np.uint8).astype(bool)
                v = unpacked(p["vectors"], len(asks), p["dims"])[asks]
                yield pa.RecordBatch.from_pydict({
                    "key": pa.array(np.frombuffer(p["rows"], np.int64)[asks]), "query_id": pa.array(np.frombuffer(p["ids"], np.int64)[asks]),
                    "dims": pa.array(np.full(len(v), p["dims"]), pa.int32()), "q": pa.array([x.tobytes() for x in v], pa.binary()),
                })

    leaves = pages.where("leaf").select("rows", "ids", "asks", "vectors", "dims")
    return leaves.mapInArrow(run, "key bigint, query_id bigint, dims int, q binary")


def _meet(cells: DataFrame, queries: DataFrame, solve: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``solve`` on the rows of a cell and on at most about ``BLOCK`` of the queries sent to it; a cell is copied per block."""
    count = queries.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    count = broadcast_if_small(count)
    left = cells.join(count, "cell").withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))).drop("blocks")
    right = queries.join(count, "cell").withColumn("block", F.expr("CAST(pmod(xxhash64(key), blocks) AS int)")).drop("blocks")
    return left.groupBy("cell", "block").cogroup(right.groupBy("cell", "block")).applyInArrow(solve, schema)


def _state(queries: pa.Table, k: int) -> Best:
    get = lambda c, none: np.array(queries.column(c).fill_null(none).to_numpy(), np.int64)
    return Best(get("score", _NONE.min), get("last", _NONE.max), k)


def _matrix(queries: pa.Table, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(queries.column("q").to_pylist()), np.int64).reshape(queries.num_rows, dims)


def route(roots: DataFrame, queries: DataFrame, most: float, first: bool) -> DataFrame:
    """(key, cell, promise, lowest): for every query the best tree of a block of roots, or all that beat its score."""

    def solve(here: pa.Table, asking: pa.Table) -> pa.Table:
        out = {"key": [], "tree": [], "promise": [], "lowest": []}
        for d in np.unique(asking.column("dims").to_numpy()).tolist():
            trees = here.filter(pa.compute.equal(here.column("dims"), d))
            mine = asking.filter(pa.compute.equal(asking.column("dims"), d))
            if not trees.num_rows:
                continue
            pivots = np.frombuffer(b"".join(trees.column("pivot").to_pylist())).reshape(-1, d + 1)
            q = np.hstack([_matrix(mine, d).astype(np.float64), np.zeros((mine.num_rows, 1))])
            up = highest(((q * q).sum(axis=1) + most)[:, None], distances(q, pivots) - trees.column("radius").to_numpy()[None, :], d)
            number, lowest = trees.column("tree").to_numpy(), trees.column("lowest").to_numpy()
            if first:
                order = np.lexsort((lowest, number))  # the smallest lowest id among equal promises
                pick = np.arange(len(up)), order[up[:, order].argmax(axis=1)]
            else:
                pick = np.nonzero(_state(mine, 1).beats(np.arange(len(up)), up, lowest) & (mine.column("done").to_numpy()[:, None] != number[None, :]))
            out["key"].append(mine.column("key").to_numpy()[pick[0]])
            out["tree"].append(number[pick[1]])
            out["promise"].append(up[pick])
            out["lowest"].append(lowest[pick[1]])
        return pa.table({c: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for c, x in out.items()})

    return _meet(roots, queries, solve, "key bigint, tree bigint, promise bigint, lowest bigint")


def search(pages: DataFrame, queries: DataFrame, most: float, k: int) -> DataFrame:
    """(key, vec_id, score): what a tree holds that beats the score its queries bring along, at most k for each."""

    def solve(here: pa.Table, asking: pa.Table) -> pa.Table:
        out = [np.zeros((0,), np.int64)] * 3
        if here.num_rows and asking.num_rows:
            best = _state(asking, k)
            keys = asking.column("key").to_numpy()
            Search(here, _matrix(asking, here.column("dims")[0].as_py()), keys, best, most).run()
            out = [np.repeat(keys, k).reshape(-1, k)[best.found], best.ids[best.found], best.scores[best.found]]
        return pa.table(dict(zip(("key", "vec_id", "score"), map(pa.array, out))))

    return _meet(pages, queries, solve, "key bigint, vec_id bigint, score bigint")


def _kept(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, asks: Column, k: int = 5, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of every row for which ``asks`` holds.

    Components become floor(scale * x); all other rows are candidates, ties go to the smaller id, ranks begin at 1. Vectors
    that are null, hold null or non-finite components, have no id, or have a squared norm of 2^62 or more (scores would not
    fit a long) take no part; vectors of different lengths are not compared. A repeated row is a row of its own: it may
    be found, and asks once more. With fewer candidates all are returned, an empty table gives an empty result. Other
    columns are not read.
    """
    pages, most = index(quantised(vectors, scale, vec_id, embedding, asks))
    roots = pages.where("page = 0").select(F.col("cell").alias("tree"), "dims", "pivot", "radius", "lowest")
    blocks = max(1, -(-roots.count() // ROOTS))
    roots = roots.withColumn("cell", F.pmod(F.xxhash64("tree"), F.lit(blocks)).cast("bigint"))
    queries = checkpoint(_queries(pages))
    none = F.lit(None).cast("bigint")

    everywhere = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint")))
    asked = queries.select("*", none.alias("score"), none.alias("last"), none.alias("done"), everywhere.alias("cell"))
    promises = route(roots, asked, most, True)
    best = F.max_by("tree", F.struct("promise", -F.col("lowest"), -F.col("tree"))).alias("done")
    homes = checkpoint(promises.groupBy("key").agg(best))
    start = queries.join(homes, "key").select("*", F.col("done").alias("cell"), none.alias("score"), none.alias("last"))
    found = checkpoint(search(pages, start, most, k))

    least = found.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("score", -F.col("vec_id"))).alias("w"))
    least = least.where(F.col("n") >= k).select("key", F.col("w.score").alias("score"), (-F.col("w.col2")).alias("last"))
    known = queries.join(homes, "key").join(least, "key", "left")
    further = route(roots, known.withColumn("cell", everywhere), most, False).select("key", F.col("tree").alias("cell"))
    more = search(pages, checkpoint(known.join(further, "key")), most, k)
    result = _kept(found.unionByName(more), k)
    return result.join(queries.select("key", "query_id"), "key").select("query_id", "rank", "vec_id", "score")


def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest inner products of every vector whose id is divisible by 50."""
    return top_k(read(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.expr("vec_id % 50 = 0"))


QUERIES = {"op13_exact_top_k": op13_exact_top_k}
ORACLE_SQL = {"op13_exact_top_k": """
WITH rows AS (
  SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), v AS (SELECT r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM rows),
scored AS (
  SELECT q.r AS r, q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) <= 5
"""}
