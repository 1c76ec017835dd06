"""Work that has to stay near the size of its input or output, on small tables."""

import datetime as dt

import numpy as np
import pytest

from sparkpoison.functions import catalogue as cat
from sparkpoison.operators import clustering as cl, correlate, graphs, provenance as pv, vectors as vc
from sparkpoison.plans.vectors import vector_dimensions
from test_graphs import CYCLIC, graph, made


@pytest.mark.parametrize("acyclic", [False, True])
def test_paths_are_not_stored_whole(spark, monkeypatch, acyclic):
    edges = [(n // 2, n) for n in range(1, 600)] + [(n // 3, n) for n in range(3, 600)]
    nodes = spark.createDataFrame([(n, 0.9 if n % 4 == 0 else 0.0) for n in range(600)], "node_id long, contamination_score double")
    starts, stored = nodes.selectExpr("node_id AS start_id"), []
    kept = pv.checkpoint
    monkeypatch.setattr(pv, "checkpoint", lambda df: (lambda out: (stored.append(out.count()), out)[1])(kept(df)))
    rows = pv.contamination_paths(nodes, graph(spark, edges), starts, everywhere=True, acyclic=acyclic, text=">")
    got = sorted(map(tuple, rows.collect()))
    assert sum(stored) < len(got)
    level = pv.contamination_paths(nodes, graph(spark, edges), starts)
    assert got == sorted((*r[:3], ">".join(map(str, r[3])), *r[4:]) for r in level.collect())


@pytest.mark.parametrize("depth", [1, 2, 5])
def test_lineage_with_loops(spark, depth):
    for edges in (CYCLIC, made(3, 12, 20, False)):
        nodes = spark.createDataFrame([(n, f"k{n}") for n in range(13) if n != 4], "node_id long, node_type string")
        starts = spark.createDataFrame([(1,), (7,), (9,), (50,)], "start_id long")
        rows = [pv.lineage(nodes, graph(spark, edges), starts, depth, everywhere=e).select("start_id", "node_id", "depth", "path", "node_type") for e in (False, True)]
        assert sorted(map(tuple, rows[0].collect())) == sorted(map(tuple, rows[1].collect()))


@pytest.mark.parametrize("block", [5, 64])
def test_clusters_in_many_tiles(spark, monkeypatch, block):
    """Rows sent to the tasks stay within a fixed number of copies of the vectors, whatever the cells."""
    from test_brute_force import _dbscan

    rng, sent = np.random.default_rng(2), []
    x = np.concatenate([rng.normal(c, 0.3, (60, 6)) for c in np.eye(6)[:4] * 2] + [rng.normal(0, 1, (80, 6)), np.zeros((2, 6))])
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    monkeypatch.setattr(cl, "_TILE", 20, raising=False)
    kept = cl._renewed
    monkeypatch.setattr(cl, "_renewed", lambda df, names: (sent.append(df.count()), kept(df, names))[1])
    df = spark.createDataFrame([(0, i, [float(v) for v in row]) for i, row in enumerate(x)], "batch_id int, vec_id long, embedding array<double>")
    got = {r.vec_id: r.cluster_label for r in cl.dbscan_cosine(df, 0.05, 4, block).collect()}
    assert [got[i] for i in range(len(x))] == _dbscan(u, 0.05, 4)
    near = {r.vec_id: r.neighbours for r in cl.neighbour_counts(df, 0.05, block).collect()}
    assert [near[i] for i in range(240)] == [int((1 - u @ u[i] <= 0.05).sum()) for i in range(240)]
    assert max(sent) <= 12 * len(x)


def test_event_clusters_are_found_among_stages(spark, monkeypatch):
    """What is iterated over does not grow with the entities."""
    (a, _), (b, _) = [next((t, s) for t, s in cat.KILL_CHAIN.items() if s == stage) for stage in list(dict.fromkeys(cat.KILL_CHAIN.values()))[:2]]
    start, seen = dt.datetime(2024, 1, 1), []
    rows = [(i, f"e{i % 50}", a if i % 3 else b, start + dt.timedelta(minutes=i % 7 + 300 * (i % 2))) for i in range(400)]
    kept = correlate.connected_components
    monkeypatch.setattr(correlate, "connected_components", lambda e: (seen.append(e.count()), kept(e))[1])
    events = correlate.classify(spark.createDataFrame(rows, "event_id long, entity_id string, technique string, ts timestamp"))
    assert {r.event_id: r.cluster_id for r in correlate.clusters(events).collect()} == {i: i % 2 for i in range(400)}
    assert seen[0] < 30


def test_stored_batches_have_no_limit(spark):
    df = spark.range(60_000).selectExpr("1 AS batch_id", "id AS vec_id", "array_repeat(1.0D, 64) AS embedding")
    assert vector_dimensions(df).first().violations == ""
    assert vc.check_dims(df).first().violations == ["too_many_vectors"]


def test_walks_broadcast_nothing(spark, monkeypatch):
    """Sides of joins in loops grow with the graph, so none may go to the driver, however small it seems."""
    plans = []
    for module in (pv, graphs):
        for name in ("checkpoint", "stored"):
            if hasattr(module, name):
                kept = getattr(module, name)
                monkeypatch.setattr(module, name, lambda df, kept=kept: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), kept(df))[1])
    edges = graph(spark, [(n // 2, n) for n in range(1, 40)])
    nodes = spark.createDataFrame([(n, 0.9 if n % 4 == 0 else 0.0) for n in range(40)], "node_id long, contamination_score double")
    pv.reachable(edges, spark.createDataFrame([(1,)], "start_id long"))
    pv.propagate(nodes, edges, nodes.selectExpr("node_id", "contamination_score AS score").where("score > 0"))
    way = spark.createDataFrame([(0, n, n + 1, 1, n) for n in range(20)], "way int, node long, to long, steps long, low long")
    graphs.leap(way, 20)
    joins = [line for plan in plans for line in plan.splitlines() if "Join " in line]
    assert len(joins) > 20 and all("strategy=merge" in line for line in joins), joins[:3]


def test_service_report_shuffles_no_text(spark, sf_dir):
    """Only the statistics of the documents meet the deviations of their embeddings."""
    from sparkpoison.operators import rag
    from sparkpoison.plans.text import rag_risk_service
    from sparkpoison.plans.views import table

    docs, vectors = table(spark, sf_dir, "docs"), table(spark, sf_dir, "vectors")
    plan = rag_risk_service(docs, vectors)._jdf.queryExecution().optimizedPlan().toString()
    scan, join = plan.index("MapInArrow"), plan.index("Join LeftOuter, (doc_id")
    assert join < scan
    devs = rag.cosine_deviation(vectors.withColumnRenamed("vec_id", "doc_id"), vc.centroid(vectors)).select("doc_id", "cosine_deviation")
    both = docs.join(devs, "doc_id", "left").na.fill(0.0, ["cosine_deviation"])
    got = [sorted(map(str, df.select(sorted(df.columns)).collect())) for df in (rag.service_scan(docs, devs), rag.rag_scan(both, "service", "cosine_deviation"))]
    assert got[0] == got[1] and len(got[0]) == docs.count()
