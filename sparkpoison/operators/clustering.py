"""Density clustering of embeddings per batch, and connected components.

Vectors of a batch are dealt to a bounded number of tiles, and every pair of tiles is one task, so
rows sent grow with the vectors. A task cuts its tiles into cells of at most ``_BLOCK`` rows by
a tree of pivots and multiplies two cells only if the triangle inequality on angles leaves room
for a neighbour; it returns counts or one star per local component, never the pairs themselves.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sparkpoison.functions.stats import with_position
from sparkpoison.session import broadcast_if_small, checkpoint

#: points of one cell at most, as long as pivots can tell them apart, and pivots about which a larger one is divided
_BLOCK = 2048
_FAN = 32
#: points of a tile at least, tiles of a batch at most, and bytes of a tile beyond which there are more
_TILE = 256
_TILES = 12
_TILE_BYTES = 128 << 20
#: rows and pairs of one matrix product
_ROWS = 1024
_PRODUCT = 1 << 20
_GROUP = 50_000


def _unit(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    rows = len(flat)
    matrix = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms > 0, norms, 1.0)


def two_nearest(vecs: DataFrame, centres: DataFrame) -> DataFrame:
    """Nearest and second nearest centre (cosine distance) of each vector within its batch.

    ``centres(batch_id, label, centroid)``. A batch's vectors are spread over groups of about
    50,000, each meeting the batch's centres in one matrix product.
    """
    groups = vecs.groupBy("batch_id").agg(F.ceil(F.count("*") / _GROUP).cast("int").alias("_groups"))
    groups = broadcast_if_small(checkpoint(groups))
    left = vecs.join(groups, "batch_id").withColumn("_salt", F.pmod(F.xxhash64("vec_id"), F.col("_groups")))
    right = centres.join(groups, "batch_id").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_groups").cast("bigint") - 1))
    )

    def nearest(rows: pa.Table, mids: pa.Table) -> pa.Table:
        if rows.num_rows == 0 or mids.num_rows == 0:
            return schema.empty_table()
        mids = mids.sort_by("label")
        names = mids.column("label").to_numpy()
        distance = 1.0 - _unit(rows.column("embedding")) @ _unit(mids.column("centroid")).T
        order = np.argsort(distance, axis=1, kind="stable")[:, :2]
        at = np.arange(len(distance))
        second = order[:, 1] if order.shape[1] > 1 else None
        return pa.table(
            {
                "batch_id": rows.column("batch_id"), "vec_id": rows.column("vec_id"),
                "nearest": names[order[:, 0]].astype(np.int64), "distance": distance[at, order[:, 0]],
                "second": pa.nulls(len(at), pa.int64()) if second is None else names[second].astype(np.int64),
                "second_distance": pa.nulls(len(at), pa.float64()) if second is None else distance[at, second],
            },
            schema=schema,
        )

    ids = {n: pa.int32() if t == "int" else pa.int64() for n, t in vecs.dtypes if n in ("batch_id", "vec_id")}
    schema = pa.schema(
        [("batch_id", ids["batch_id"]), ("vec_id", ids["vec_id"]), ("nearest", pa.int64()),
         ("distance", pa.float64()), ("second", pa.int64()), ("second_distance", pa.float64())]
    )
    ddl = ", ".join(f"{f.name} {_ddl(f.type)}" for f in schema)
    return (
        left.select("batch_id", "_salt", "vec_id", "embedding").groupBy("batch_id", "_salt")
        .cogroup(_renewed(right, ["batch_id", "_salt", "label", "centroid"]).groupBy("batch_id", "_salt"))
        .applyInArrow(nearest, ddl)
    )


def _renewed(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The columns under new identities, so both sides of a cogroup may stem from one table."""
    return df.select(*[F.col(n).alias(n) for n in names])


def _ddl(kind: pa.DataType) -> str:
    return {"int32": "int", "int64": "bigint", "double": "double"}[str(kind)]


def _tiles(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(points with their tile, pairs of tiles) of ``points(batch_id, vec_id, embedding, …)``.

    A batch is dealt by hash to tiles whose number is bounded, so a point meets the batch in that many tasks however large
    the batch is; only beyond ``_TILE_BYTES`` a tile, which bound a task's memory, are there more. Every pair of tiles is one task.
    """
    sizes = points.groupBy("batch_id").agg(F.count("*").alias("_n"), F.max(F.size("embedding")).alias("_d"))
    fit = F.ceil(F.col("_n") * F.col("_d") * 8 / _TILE_BYTES)
    tiles = F.greatest(F.least(F.ceil(F.col("_n") / _TILE), F.lit(_TILES)), fit, F.lit(1)).cast("bigint")
    sizes = checkpoint(sizes.select("batch_id", tiles.alias("_tiles")))
    placed = points.join(broadcast_if_small(sizes), "batch_id").withColumn("tile", F.pmod(F.xxhash64("vec_id"), F.col("_tiles"))).drop("_tiles")
    each = F.sequence(F.lit(0).cast("bigint"), F.col("_tiles") - 1)
    pairs = sizes.select("batch_id", "_tiles", F.explode(each).alias("ta"))
    pairs = pairs.select("batch_id", "ta", F.explode(F.sequence("ta", F.col("_tiles") - 1)).alias("tb"))
    return checkpoint(placed), broadcast_if_small(checkpoint(pairs))


_PAIR = ["batch_id", "ta", "tb"]


def _per_pair(points: DataFrame, pairs: DataFrame, columns: Sequence[str], fn, ddl: str) -> DataFrame:
    """Run ``fn(left rows, right rows)`` on the members of every pair of tiles; a tile meets itself with no right rows."""
    cols = [*_PAIR, "vec_id", "embedding", *columns]
    left = points.withColumnRenamed("tile", "ta").join(pairs, ["batch_id", "ta"]).select(*cols)
    right = points.withColumnRenamed("tile", "tb").join(pairs.where("ta <> tb"), ["batch_id", "tb"]).select(*cols)
    return left.groupBy(*_PAIR).cogroup(_renewed(right, cols).groupBy(*_PAIR)).applyInArrow(fn, ddl)


def _same(left: pa.Table) -> bool:
    """Whether the rows are of a tile that meets itself."""
    return left.num_rows > 0 and left.column("ta")[0] == left.column("tb")[0]


def _cells(unit: np.ndarray, block: int) -> tuple[np.ndarray, list[tuple[int, int]], np.ndarray, np.ndarray]:
    """(order, bounds, centres, radii): the rows cut into cells of at most ``block`` by a tree of pivots, and each cell's ball.

    A cell that does not shrink, because its rows are alike, is cut where it stands.
    """
    leaves, open_ = [], [np.arange(len(unit))]
    rng = np.random.default_rng(len(unit))
    while open_:
        at = open_.pop()
        if len(at) <= block:
            leaves.append(at)
            continue
        pivots = unit[rng.choice(at, min(_FAN, -(-2 * len(at) // block), len(at)), replace=False)]
        nearest = np.argmax(unit[at] @ pivots.T, axis=1)
        by = np.argsort(nearest, kind="stable")
        parts = [p for p in np.split(at[by], np.flatnonzero(np.diff(nearest[by])) + 1) if len(p)]
        if max(map(len, parts)) > 0.9 * len(at):
            leaves += [at[i : i + block] for i in range(0, len(at), block)]
        else:
            open_ += parts
    order = np.concatenate(leaves) if leaves else np.arange(0)
    ends = np.cumsum([len(x) for x in leaves])
    bounds = [(int(e) - len(x), int(e)) for x, e in zip(leaves, ends)]
    centres = np.stack([unit[x].mean(axis=0) for x in leaves]) if leaves else unit[:0]
    norms = np.linalg.norm(centres, axis=1, keepdims=True)
    centres = centres / np.where(norms > 0, norms, 1.0)
    radii = np.array([np.arccos(np.clip((unit[x] @ c).min(), -1.0, 1.0)) for x, c in zip(leaves, centres)])
    # A zero row or centre has no angle; such a cell is kept apart from no other.
    radii[[not (n and np.linalg.norm(unit[x], axis=1).all()) for x, n in zip(leaves, norms[:, 0])]] = np.pi
    return order, bounds, centres, radii


def _near(a: np.ndarray, b: np.ndarray | None, eps: float, block: int, wanted=None):
    """Yield (rows, columns, near): index arrays into ``a`` and ``b`` (``a`` itself for None) and which of them are within eps.

    Cells whose balls leave no room for a near pair are passed over; what is left is multiplied about a million pairs at a
    time. Without ``b`` every two rows meet at least once. ``wanted(rows, columns)`` may spare a product.
    """
    theta = float(np.arccos(np.clip(1.0 - eps, -1.0, 1.0))) + 1e-6
    order_a, bounds_a, mid_a, rad_a = _cells(a, block)
    order_b, bounds_b, mid_b, rad_b = (order_a, bounds_a, mid_a, rad_a) if b is None else _cells(b, block)
    other = a if b is None else b
    a, other = a[order_a], other[order_b]
    at = 0
    sizes = np.array([e - s for s, e in bounds_b])
    starts = np.array([s for s, _ in bounds_b])
    while at < len(bounds_a):
        # some cells that stand together, as far as they share most of their candidates
        angles = np.arccos(np.clip(mid_a[at] @ mid_b.T, -1.0, 1.0))
        close = angles <= rad_a[at] + rad_b + theta
        upto = at + 1
        while upto < len(bounds_a) and bounds_a[upto][1] - bounds_a[at][0] <= _ROWS:
            more = np.arccos(np.clip(mid_a[upto] @ mid_b.T, -1.0, 1.0)) <= rad_a[upto] + rad_b + theta
            both = close | more
            if sizes[both].sum() > 1.5 * min(sizes[close].sum(), max(sizes[more].sum(), 1)) + block:
                break
            close, upto = both, upto + 1
        if b is None:
            close[:at] = False  # the earlier cells have met these
        rows = np.arange(bounds_a[at][0], bounds_a[upto - 1][1])
        picked = np.flatnonzero(close)
        if len(picked):
            reps = sizes[picked]
            columns = np.repeat(starts[picked] - np.concatenate([[0], np.cumsum(reps)[:-1]]), reps) + np.arange(reps.sum())
            step, held = max(1, _PRODUCT // len(rows)), a[rows]
            for c in range(0, len(columns), step):
                part = columns[c : c + step]
                ra, cb = order_a[rows], order_b[part]
                if wanted is None or wanted(ra, cb):
                    far = held @ other[part].T
                    np.subtract(1.0, far, out=far)
                    yield ra, cb, far <= eps, rows, part
        at = upto


def _neighbour_weight(points: DataFrame, pairs: DataFrame, eps: float, block: int) -> DataFrame:
    """Total weight within ``eps`` of every point, itself included."""

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        alone = _same(left)
        if not alone and not (left.num_rows and right.num_rows):
            return pa.table({"vec_id": pa.array([], pa.int64()), "near": pa.array([], pa.int64())})
        sides = [left] if alone else [left, right]
        weights = [x.column("weight").to_numpy().astype(np.float64) for x in sides]
        totals = [np.zeros(len(w)) for w in weights]
        a, b = _unit(left.column("embedding")), None if alone else _unit(right.column("embedding"))
        for ra, cb, near, rows, columns in _near(a, b, eps, block):
            if alone:
                near[rows[:, None] >= columns[None, :]] = False  # each two rows once, a row itself below
            near = near.astype(np.float64)
            totals[0][ra] += near @ weights[-1][cb]
            totals[-1][cb] += weights[0][ra] @ near
        if alone:
            totals[0] += weights[0]
        ids = pa.chunked_array([c for x in sides for c in x.column("vec_id").cast(pa.int64()).chunks])
        return pa.table({"vec_id": ids, "near": np.concatenate(totals).astype(np.int64)})

    partial = _per_pair(points, pairs, ["weight"], count, "vec_id bigint, near bigint")
    return partial.groupBy("vec_id").agg(F.sum("near").alias("neighbours"))


def _joined(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """``label`` (the least member of each row's component) after the edges u, v."""
    names, at = np.unique(np.concatenate([label[u], label[v]]), return_inverse=True)
    u, v = at[: len(u)], at[len(u) :]
    low = np.arange(len(names))
    while True:
        least = np.minimum(low[u], low[v])
        after = low.copy()
        np.minimum.at(after, u, least)
        np.minimum.at(after, v, least)
        after = after[after]
        if np.array_equal(after, low):
            break
        low = after
    renamed = np.arange(len(label))
    renamed[names] = names[low]
    return renamed[label]


def _local_links(points: DataFrame, pairs: DataFrame, eps: float, block: int) -> DataFrame:
    """Per pair of tiles: each core point's local component, and each other point's adjacent components."""

    def link(left: pa.Table, right: pa.Table) -> pa.Table:
        alone = _same(left)
        if not alone and not (left.num_rows and right.num_rows):
            return pa.table({"vec_id": pa.array([], pa.int64()), "rep": pa.array([], pa.int64())})
        both = left if alone else pa.concat_tables([left, right.cast(left.schema)])
        ids = both.column("vec_id").to_numpy().astype(np.int64)
        by = np.argsort(ids)
        rank = np.empty(len(ids), np.int64)
        rank[by] = np.arange(len(ids))  # components are named by rank, so the least rank is the least id
        core = both.column("is_core").to_numpy(zero_copy_only=False)
        unit, na = _unit(both.column("embedding")), left.num_rows
        shift = 0 if alone else na
        label, beside = np.arange(len(ids)), []

        def wanted(ra, cb):
            x, y = rank[ra], rank[cb + shift]
            cx, cy = core[ra], core[cb + shift]
            if not (cx.all() and cy.all()):
                return bool(cx.any() or cy.any())
            first = label[x[0]]
            return bool((label[x] != first).any() or (label[y] != first).any())

        for ra, cb, near, _, _ in _near(unit[:na], None if alone else unit[na:], eps, block, wanted):
            x, y = rank[ra], rank[cb + shift]
            cx, cy = core[ra], core[cb + shift]
            # Points that are no cores have few neighbours, so theirs are listed.
            if not cx.all():
                i, j = np.nonzero(near[~cx][:, cy])
                beside.append((x[~cx][i], y[cy][j]))
            if not cy.all():
                i, j = np.nonzero(near[cx][:, ~cy])
                beside.append((y[~cy][j], x[cx][i]))
            x, y = x[cx], y[cy]
            inner = near if cx.all() and cy.all() else near[cx][:, cy]
            while inner.size:
                # Of each row and column one edge to another component, until none is left.
                across = inner & (label[x][:, None] != label[y][None, :])
                rows = np.flatnonzero(across.any(axis=1))
                if not len(rows):
                    break
                columns = np.flatnonzero(across.any(axis=0))
                u = np.concatenate([x[rows], x[across[:, columns].argmax(axis=0)]])
                v = np.concatenate([y[across[rows].argmax(axis=1)], y[columns]])
                label = _joined(label, u, v)
        names = ids[by]
        out = [(ids[core], names[label[rank[core]]])]
        if beside:
            point, other = (np.concatenate(z) for z in zip(*beside))
            if len(point):
                out.append(tuple(np.unique(np.stack([names[point], names[label[other]]]), axis=1)))
        return pa.table({"vec_id": np.concatenate([o[0] for o in out]), "rep": np.concatenate([o[1] for o in out])})

    return _per_pair(points, pairs, ["is_core"], link, "vec_id bigint, rep bigint").distinct()


#: edges one task contracts at a time
_EDGES = 1_000_000


def _contracted(edges: DataFrame, count: int) -> DataFrame:
    """Edges (u, v) replaced, a million at a time, by stars around their local minima."""
    kind = dict(edges.dtypes)["u"]

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        ends = pa.concat_arrays([table.column(i).combine_chunks() for i in (0, 1)])
        names, at = np.unique(ends.to_numpy(zero_copy_only=False), return_inverse=True)
        u, v = at[: table.num_rows], at[table.num_rows :]
        label = np.arange(len(names))
        while True:
            low = np.minimum(label[u], label[v])
            after = label.copy()
            np.minimum.at(after, u, low)
            np.minimum.at(after, v, low)
            after = after[after]
            if np.array_equal(after, label):
                break
            label = after
        moved = np.flatnonzero(label != np.arange(len(names)))
        columns = [pa.array(names[moved], ends.type), pa.array(names[label[moved]], ends.type)]
        return pa.RecordBatch.from_arrays(columns, ["u", "v"])

    def contract(batches):
        held, rows = [], 0
        for batch in batches:
            if rows and rows + batch.num_rows > _EDGES:
                yield stars(held)
                held, rows = [], 0
            held.append(batch)
            rows += batch.num_rows
        if rows:
            yield stars(held)

    # coalesce(1) is one task whatever the session's settings; more edges are dealt by their smaller end.
    dealt = edges.coalesce(1) if count <= _EDGES else edges.repartition(-(-count // _EDGES), "v")
    return dealt.mapInArrow(contract, f"u {kind}, v {kind}")


def connected_components(edges: DataFrame, left: str = "u", right: str = "v") -> DataFrame:
    """(node, component) where a component is named by its smallest node.

    Each round, tasks first contract the edges they hold to stars; then alternating large and
    small stars join what different tasks hold: every node meets the minimum of its
    neighbourhood through a map-side combined aggregate, until all that remains are stars.
    """
    high, low = F.greatest(left, right), F.least(left, right)
    edges = checkpoint(edges.select(left, right).distinct())
    nodes = edges.select(F.col(left).alias("node")).union(edges.select(F.col(right))).distinct()
    stars = edges.select(high.alias("u"), low.alias("v")).where(F.col("u") != F.col("v"))
    mark = lambda: stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen = mark()
    count = seen[0]
    while True:
        stars = checkpoint(_contracted(stars, count))
        if count <= _EDGES:
            break  # one task held all edges at once: only stars are left
        before, seen = seen, mark()
        if before == seen:
            break
        ends = F.array(F.struct(F.col("u").alias("x"), F.col("v").alias("y")), F.struct(F.col("v").alias("x"), F.col("u").alias("y")))
        both = stars.select(F.inline(ends))
        smallest = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        large = checkpoint(
            both.where(F.col("y") > F.col("x")).join(smallest, "x")
            .select(F.col("y").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        )
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        ends = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        stars = checkpoint(large.join(lowest, "u").select(F.inline(ends)).where(F.col("u") != F.col("v")).distinct())
        count = stars.count()
    return nodes.join(stars, nodes["node"] == stars["u"], "left").select(
        "node", F.coalesce("v", "node").alias("component")
    )


def neighbour_counts(vecs: DataFrame, eps: float = 0.15, block: int | None = None) -> DataFrame:
    """How many vectors of its batch, itself included, lie within ``eps`` of each vector."""
    points, members = _distinct_points(vecs)
    placed, pairs = _tiles(points)
    near = _neighbour_weight(placed, pairs, eps, block or _BLOCK)
    return members.join(near.withColumnRenamed("vec_id", "rep"), "rep").select("batch_id", "vec_id", "neighbours")


def _distinct_points(vecs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Equal vectors become one weighted point, so a mass of copies costs one row."""
    points = checkpoint(
        vecs.groupBy("batch_id", "embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("weight"))
    )
    copied = points.where(F.col("weight") > 1).select("batch_id", "embedding", F.col("vec_id").alias("_rep"))
    members = (
        vecs.select("batch_id", "vec_id", "embedding").join(copied, ["batch_id", "embedding"], "left")
        .select("batch_id", "vec_id", F.coalesce("_rep", "vec_id").alias("rep"))
    )
    if dict(points.dtypes)["vec_id"] in ("bigint", "int", "smallint", "tinyint"):
        return points, members
    # Ids of another type are numbered in their order; members keep their own.
    every = points.select("vec_id", F.lit(0).alias("_all"))
    place = checkpoint(with_position(every, ["_all"], [F.col("vec_id")]).select("vec_id", F.col("pos").cast("bigint").alias("_at")))
    points = points.join(place, "vec_id").withColumn("vec_id", F.col("_at")).drop("_at")
    members = members.join(place.withColumnRenamed("vec_id", "rep"), "rep").withColumn("rep", F.col("_at")).drop("_at")
    return checkpoint(points), members


def dbscan_cosine(vecs: DataFrame, eps: float = 0.15, min_samples: int = 5, block: int | None = None) -> DataFrame:
    """(batch_id, vec_id, cluster_label) with -1 for noise; exact, numbered by smallest core id.

    ``vecs(batch_id, vec_id, embedding)`` with ``vec_id`` unique over all batches.
    """
    points, members = _distinct_points(vecs)
    placed, pairs = _tiles(points)
    near = _neighbour_weight(placed, pairs, eps, block or _BLOCK)
    cores = near.select("vec_id", (F.col("neighbours") >= min_samples).alias("is_core"))
    flagged = checkpoint(placed.join(cores, "vec_id").drop("weight"))
    links = checkpoint(_local_links(flagged, pairs, eps, block or _BLOCK))
    core_ids = flagged.where("is_core").select("vec_id")
    core_links = links.join(core_ids, "vec_id", "left_semi")
    parts = connected_components(core_links.select(F.col("vec_id").alias("u"), F.col("rep").alias("v")))
    # A core point belongs to its component; another point to the lowest adjacent one.
    owner = (
        links.join(parts, links["rep"] == parts["node"])
        .groupBy("vec_id").agg(F.min("component").alias("component"))
    )
    clusters = flagged.select("batch_id", "vec_id").join(owner, "vec_id", "left")
    named = with_position(
        clusters.where(F.col("component").isNotNull()).select("batch_id", "component").distinct(),
        ["batch_id"], [F.col("component")],
    ).select("component", (F.col("pos") - 1).alias("cluster_label"))
    labelled = clusters.join(named, "component", "left").select(
        F.col("vec_id").alias("rep"), F.coalesce("cluster_label", F.lit(-1)).cast("bigint").alias("cluster_label")
    )
    return members.join(labelled, "rep").select("batch_id", "vec_id", "cluster_label")


def cluster_stats(labels: DataFrame) -> DataFrame:
    noise = F.col("cluster_label") == -1
    return labels.groupBy("batch_id").agg(
        F.coalesce(F.max("cluster_label") + 1, F.lit(0)).cast("bigint").alias("cluster_count"),
        F.avg(noise.cast("double")).alias("noise_ratio"),
    )


def split_view(vecs: DataFrame, labels: DataFrame, threshold: float = 0.60) -> DataFrame:
    """Vectors nearly as close to a second cluster centroid as to their nearest one."""
    from sparkpoison.operators.vectors import centroid

    clustered = vecs.join(labels.where(F.col("cluster_label") >= 0).select("vec_id", "cluster_label"), "vec_id")
    centres = centroid(clustered, ["batch_id", "cluster_label"]).select(
        "batch_id", F.col("cluster_label").alias("label"), "centroid"
    )
    near = two_nearest(vecs, checkpoint(centres)).where(F.col("second_distance") >= 1e-12)
    d1, d2 = F.col("distance"), F.col("second_distance")
    overlap = F.when(d2 > d1, d1 / d2).otherwise(1.0)
    severity = F.when(F.col("overlap_ratio") > 0.90, "critical").when(F.col("overlap_ratio") > 0.80, "high")
    return (
        near.withColumn("overlap_ratio", overlap).where(F.col("overlap_ratio") >= threshold)
        .select(
            "batch_id", "vec_id", F.col("nearest").alias("primary_cluster"),
            F.col("second").alias("secondary_cluster"), "overlap_ratio", severity.otherwise("medium").alias("severity"),
        )
    )
