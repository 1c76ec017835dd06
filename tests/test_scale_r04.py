"""Lineage questions whose stored rows have to stay near the size of the graph."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sparkpoison.operators import graphs, provenance as pv
from test_graphs import CYCLIC, graph, links, made, simple_paths


@pytest.fixture
def stored_bytes(monkeypatch):
    """Characters of all rows that operators store, as JSON."""
    sizes = []
    for module in (pv, graphs):
        for name in ("checkpoint", "stored"):
            if hasattr(module, name):
                kept = getattr(module, name)

                def counted(df, kept=kept):
                    out = kept(df)
                    sizes.append(out.agg(F.sum(F.length(F.to_json(F.struct(*[F.col(c) for c in out.columns]))))).first()[0] or 0)
                    return out

                monkeypatch.setattr(module, name, counted)
    return sizes


def checked(spark, edges, most, acyclic, missing=()):
    """check_contamination of every node, and the same by listing every path."""
    score = {n: 0.9 if n % 5 == 0 else 0.4 if n % 3 == 0 else 0.0 for n in {x for e in edges for x in e} | {99} if n not in missing}
    nodes = spark.createDataFrame(list(score.items()), "node_id long, contamination_score double")
    rows = pv.check_contamination(nodes, graph(spark, edges), nodes.selectExpr("node_id AS start_id"), acyclic, most).collect()
    up, want = links(edges, True), {}
    for n in score:
        seen = simple_paths(up, n, most)
        dirty = [score[v] * 0.7**d for v, d in seen if score.get(v, 0) > 0]
        want[n] = (len(dirty), pytest.approx(max(dirty, default=0), abs=1e-6), max(dirty, default=0) > 0.3, len({v for v, _ in seen if v in score}))
    assert {r.start_id: (r.contamination_paths, r.max_decayed_score, r.is_contaminated, r.total_ancestors) for r in rows} == want


def test_ancestors_take_no_bitmap_each(spark, stored_bytes):
    """A node has a few dozen ancestors; a bitmap for each of them and each round took 15 MB here."""
    edges = [(n // 2, n) for n in range(1, 400)] + [(n // 3, n) for n in range(3, 400)]
    checked(spark, edges, 20, True)
    assert sum(stored_bytes) < 2_000_000


@pytest.mark.parametrize("merged, dense", [(256, 1024), (2, 1024), (256, 0)], ids=["arrays", "in parts", "bitmaps"])
def test_ancestors_that_are_no_nodes_are_not_counted(spark, monkeypatch, merged, dense):
    monkeypatch.setattr(graphs, "_MERGED", merged, raising=False)
    monkeypatch.setattr(graphs, "_DENSE", dense, raising=False)
    checked(spark, made(2, 30, 85, False), 6, True, missing=(3, 7, 10))
    checked(spark, CYCLIC, 4, False, missing=(3, 6))


@pytest.mark.parametrize("operator", [pv.lineage, pv.contamination_paths])
def test_paths_leave_few_files_behind(spark, monkeypatch, operator):
    """What paths are joined from is stored, less than the paths; the shuffles that it was made with are gone."""
    kept, count = pv.stored, []
    monkeypatch.setattr(pv, "stored", lambda df: (lambda out: (count.append(out.count()), out)[1])(kept(df)))
    edges = graph(spark, [(n // 2, n) for n in range(1, 4000)] + [(n // 3, n) for n in range(3, 4000)]).localCheckpoint()
    nodes = spark.range(4000).selectExpr("id AS node_id", "IF(id % 4 = 0, 0.9D, 0.0D) AS contamination_score")

    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    folders = list(env.blockManager().diskBlockManager().localDirsString())
    left = lambda: sum(f.stat().st_size for d in folders for f in Path(d).rglob("shuffle_*") if f.exists())
    before = left()
    rows = operator(nodes, edges, nodes.selectExpr("node_id AS start_id"), 10, everywhere=True, acyclic=True, text=">")
    made = left() - before
    assert made < 100_000
    assert sum(count) < rows.count() > 100_000
