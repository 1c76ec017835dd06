import math

import numpy as np
import pytest

from sparkpoison.llm import embedding_dedup as E


def brute(rows, limit=0.98):
    """[(vec_id, n_links, component, kept)] by all pairs."""
    unit = {}
    for i, e, label in rows:
        if i is not None and label is not None and e is not None and all(x is not None and math.isfinite(x) for x in e) and any(e):
            x = np.array(e, float) / np.abs(e).max()
            unit[i] = (label, x / np.linalg.norm(x))
    ids = sorted(unit)
    parent, n = {i: i for i in ids}, dict.fromkeys(ids, 0)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and unit[a][0] == unit[b][0] and len(unit[a][1]) == len(unit[b][1]) and unit[a][1] @ unit[b][1] >= limit:
                n[a] += 1
                n[b] += 1
                lo, hi = sorted((root(a), root(b)))
                parent[hi] = lo
    return sorted([(i, n.get(i, 0), root(i) if i in parent else i, i is not None and (i not in parent or root(i) == i)) for i, _, _ in rows], key=repr)


def made(seed=0):
    rng = np.random.default_rng(seed)
    rows, at = [], 1
    for group in range(40):
        centre = rng.normal(size=24)
        for _ in range(int(rng.integers(1, 12))):
            rows.append((at, (centre + rng.normal(size=24) * rng.choice([0.02, 0.06, 0.1])).tolist(), int(group % 3)))
            at += 1
    dense = rng.normal(size=24)
    for _ in range(150):
        rows.append((at, (dense + rng.normal(size=24) * 0.07).tolist(), 1))
        at += 1
    rows += [(at + k, rows[3][1], rows[3][2]) for k in range(5)]
    rows += [(900, rows[3][1], None), (901, [0.0] * 24, 1), (902, None, 1), (903, [float("nan")] * 24, 1), (904, [1.0, None], 1), (905, [float("inf")] + [1.0] * 23, 1),
             (906, [1.0, 2.0], 1), (907, [2.0, 4.0], 1), (908, [1e200] + [1e199] * 23, 2), (909, [1e200] + [1e199] * 23, 2), (910, [], 1)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS rep", "2 AS key", "3 AS kept")


@pytest.mark.parametrize("block", [8192, 7])
def test_equals_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(E, "BLOCK", block)
    rows = made()
    assert sorted(map(tuple, E.near_duplicates(frame(spark, rows)).collect()), key=repr) == brute(rows)


def test_query(spark):
    d = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert sorted(map(tuple, E.op2_embedding_dedup(spark, d).collect()), key=repr) == brute(rows)


def test_edges(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (None, [1.0, 0.0], 1)]
    got = sorted(map(tuple, E.near_duplicates(frame(spark, rows)).collect()), key=repr)
    assert got == sorted([(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (None, 0, None, False)], key=repr)
    assert E.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_rotation_keeps_angles_and_recall():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 64))
    assert np.allclose(E.rotate(x, 3) @ E.rotate(x, 3).T, x @ x.T)
    assert E.choose_tables(64, 0.98, 2, 2) <= 24


def test_one_id_with_several_vectors(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    near = lambda e: [x + 0.01 for x in e]
    rows = [(5, a, 1), (5, b, 2), (7, near(a), 1), (8, near(b), 2), (9, b, 1), (10, near(a), 2), (3, c, 1), (8, c, 1), (20, a, 3), (20, near(a), 3), (21, a, 3)]
    links = {(i, e1, j) for i, e, g in rows for j, f, h in rows for e1 in [tuple(e)] if i != j and g == h and np.dot(e, f) >= 0.98 * np.linalg.norm(e) * np.linalg.norm(f)}
    component = {5: 3, 7: 3, 8: 3, 9: 9, 10: 10, 3: 3, 20: 20, 21: 20}
    count = {5: 2, 7: 1, 8: 2, 9: 0, 10: 0, 3: 1, 20: 2, 21: 2}
    assert {i for i, n in count.items() if n} == {i for i, *_ in links}
    got = sorted(map(tuple, E.near_duplicates(frame(spark, rows)).collect()))
    assert got == sorted((i, count[i], component[i], i == component[i]) for i, *_ in rows)


def test_small_cells_are_solved_together(spark):
    import pyarrow as pa

    from sparkpoison.llm.common import map_cells

    def solve(table):
        cells = pa.TableGroupBy(table, ["key", "i"]).aggregate([([], "count_all")])
        return pa.RecordBatch.from_arrays([pa.array([cells.num_rows]), pa.array([table.num_rows])], ["cells", "n"])

    rows = spark.range(9000).selectExpr("id div 3 AS key", "0 AS i").union(spark.range(2500).selectExpr("-7L AS key", "1 AS i"))
    got = map_cells(rows, ["key", "i"], "cells long, n long", solve, several=True).collect()
    assert (sum(r.cells for r in got), sum(r.n for r in got)) == (3001, 11500)  # no cell is cut
    assert len(got) < 60


def test_small_and_large_cells_of_one_batch(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows, at = [], 0
    for d in (3, 24):
        for group in range(60):
            centre = rng.normal(size=d)
            for _ in range(90 if group == 7 else int(rng.integers(1, 5))):
                rows.append((at, (centre + rng.normal(size=d) * 0.05).tolist(), group % 2))
                at += 1
    for small in (64, 4):
        monkeypatch.setattr(E, "_SMALL", small)
        monkeypatch.setattr(E, "_SMALL_PAIRS", 50)
        assert sorted(map(tuple, E.near_duplicates(frame(spark, rows)).collect()), key=repr) == brute(rows)


def test_growing_labels_are_not_hashed_more_often(spark, monkeypatch):
    """A second hash a table, and the tables it takes, only where comparing whole buckets would cost more."""
    asked, kept = [], E.choose_tables
    monkeypatch.setattr(E, "choose_tables", lambda d, cosine, hashes, *more: (asked.append(hashes), kept(d, cosine, hashes, *more))[1])
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2500, 64))
    x[1::5] = x[::5] + rng.normal(size=(500, 64)) * 0.05
    rows = [(i, [float(v) for v in row], 0) for i, row in enumerate(x)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in E.near_duplicates(frame(spark, rows)).collect()}
    assert got == {i: (int(i % 5 < 2), i - (i % 5 == 1)) for i in range(2500)}
    assert asked == [1] and E.choose_hashes(100_000, 64) == 2


def test_first_meeting():
    rng = np.random.default_rng(5)
    keys = rng.integers(0, 6, (40, 4, 2))
    i, j = np.triu_indices(40, 1)
    for key in range(6):
        first = [next((min(set(a) & set(b)) for a, b in zip(keys[u].tolist(), keys[v].tolist()) if set(a) & set(b)), None) for u, v in zip(i, j)]
        assert E._first_here(keys, np.full(40, key), i, j).tolist() == [f == key for f in first]
