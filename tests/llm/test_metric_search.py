import math
import random

import numpy as np
from pyspark.sql import functions as F

from sparkpoison.llm import metric_search as M


def every_product(rows, every, k=5):
    """Sorted (query_id, rank, vec_id, score) by comparing each query with each other row."""
    fit = [(i, [math.floor(256 * x) for x in e]) for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    fit = [(i, v) for i, v in fit if sum(x * x for x in v) < 1 << 62]
    out = []
    for a, (i, q) in enumerate(fit):
        if i % every == 0:
            found = sorted((-sum(x * y for x, y in zip(q, v)), j) for b, (j, v) in enumerate(fit) if a != b and len(v) == len(q))
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(found[:k], 1)]
    return sorted(out)


def searched(df, every):
    return sorted(tuple(r) for r in M.top_k(df, F.expr(f"vec_id % {every} = 0")).collect())


def test_query(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in M.op13_exact_top_k(spark, sf_dir).collect()) == every_product(rows, 50)


def test_many_trees_groups_and_ties(spark, monkeypatch):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(M, "CELL", 40)
    monkeypatch.setattr(M, "ROOTS", 3)
    near = rng.normal(size=(6, 8)) * 2
    points = [near[rng.integers(6)] + rng.normal(size=8) * 0.05 for _ in range(500)] + [near[0]] * 400 + list(rng.normal(size=(100, 8)))
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    assert searched(df, 10) == every_product(rows, 10)


def test_edges(spark):
    rng = random.Random(2)
    rows = [(0, None), (10, []), (20, []), (30, [None, 1.0]), (40, [float("nan"), 1.0]), (50, [float("inf"), 0.0]), (None, [1.0, 2.0]), (60, [0.0, 0.0])]
    rows += [(70, [1e300, 0.0]), (80, [1e6, -1e6]), (81, [1e6, 1e6]), (90, [5e5, 5e5]), (90, [5e5, 5e5]), (100, [3.0]), (110, [-0.001, 1e-9]), (-10, [1.0, 1.0])]
    rows += [(i, [rng.uniform(-1, 1), rng.uniform(-1, 1)]) for i in range(200, 230)]
    df = spark.createDataFrame([(i, e, 1, 2.0) for i, e in rows], "vec_id long, embedding array<double>, score int, page double")
    assert searched(df, 10) == every_product(rows, 10)
    assert searched(df.limit(0), 10) == []
    one = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")
    assert searched(one, 10) == []


def test_bounds_avoid_work():
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(40, 16)) * 40
    v = np.floor(np.concatenate([c + rng.normal(size=(200, 16)) for c in centres])).astype(np.int64)
    most = float((v * v).sum(axis=1).max())
    pages = M.grow(v, np.arange(len(v)), np.zeros(len(v), bool), most, 0)
    assert sorted(i for p in pages if p["leaf"] for i in np.frombuffer(p["ids"], np.int64)) == list(range(len(v)))
    import pyarrow as pa

    table, q = pa.Table.from_pylist(pages), v[::100]
    best = M.Best(np.full(len(q), M._NONE.min), np.full(len(q), M._NONE.max), 5)
    run = M.Search(table, q, np.arange(len(v))[::100], best, most)
    run.run()
    scores = q @ v.T
    scores[np.arange(len(q)), np.arange(len(v))[::100]] = M._NONE.min
    order = np.lexsort((np.broadcast_to(np.arange(len(v)), scores.shape), -np.maximum(scores, -M._NONE.max)), axis=1)[:, :5]
    assert (best.ids == order).all() and (best.scores == np.take_along_axis(scores, order, axis=1)).all()
    assert run.work < scores.size / 4
