"""Inputs on which earlier versions stalled or gave wrong results."""

import datetime as dt
import re

from sparkpoison.functions import catalogue as cat
from sparkpoison.functions.arrays import running
from sparkpoison.operators import clustering, correlate, drift, proofs, provenance, text
from sparkpoison.plans import views


def chain_of(spark, counts):
    rows = [(t, i, f"{t}-{i}") for t, n in counts.items() for i in range(n)]
    return proofs.build_chain(spark.createDataFrame(rows, "tenant_id string, idx long, result string"))


def test_roots_do_not_depend_on_other_tenants(spark):
    root = lambda counts: dict(proofs.chain_roots(chain_of(spark, counts)).collect())
    both = root({"a": 10, "b": 5000})
    assert both["a"] == root({"a": 10})["a"] and both["b"] == root({"b": 5000})["b"]


def test_missing_tail_is_found(spark):
    chain = chain_of(spark, {"a": 5000, "b": 20})
    roots = proofs.chain_roots(chain)
    cut = chain.where("tenant_id <> 'a' OR idx < 4096")
    got = {r.tenant_id: r for r in proofs.verify_chain(cut, roots=roots).collect()}
    assert got["a"].failed == 0 and not got["a"].root_valid and got["b"].root_valid
    gone = proofs.verify_chain(chain.where("tenant_id = 'b'"), roots=roots).where("tenant_id = 'a'").first()
    assert gone.records == 0 and not gone.root_valid


def test_policies_of_several_types(spark):
    metrics = spark.createDataFrame([("t", "app", {"x": 0.5, "y": 0.1})], "tenant_id string, application_id string, metrics map<string,double>")
    rows = [("t", "app", "quality", "own", 1, True, {"x": 0.4}), ("t", None, "security", "default", 1, True, {"y": 0.2}), ("t", None, "quality", "unused", 1, True, {"x": 0.9})]
    policies = spark.createDataFrame(rows, "tenant_id string, application_id string, policy_type string, name string, version int, is_active boolean, thresholds map<string,double>")
    got = {(r.policy_type, r.policy, r.breached) for r in drift.evaluate_policies(metrics, policies).collect()}
    assert got == {("quality", "own", True), ("security", "default", False)}


def test_events_without_entity_do_not_correlate(spark):
    (a, _), (b, _) = [next((t, s) for t, s in cat.KILL_CHAIN.items() if s == stage) for stage in list(dict.fromkeys(cat.KILL_CHAIN.values()))[:2]]
    at = dt.datetime(2024, 1, 1, 12)
    rows = [(1, None, a, at), (2, None, b, at), (3, "x", a, at + dt.timedelta(hours=9)), (4, "x", b, at + dt.timedelta(hours=9)), (5, "x:1", b, at + dt.timedelta(days=9))]
    found = correlate.clusters(correlate.classify(spark.createDataFrame(rows, "event_id long, entity_id string, technique string, ts timestamp")))
    assert {r.event_id for r in found.collect()} == {3, 4}


def test_positions_in_a_long_document(spark):
    """One early match in a megabyte, and thousands of matches, with characters beyond ASCII."""
    phrase = "Ignore previous instructions"
    many = ("é " + phrase + ". ") * 3000
    docs = spark.createDataFrame([(1, phrase + " x" * 500_000), (2, many)], "doc_id long, text string")
    hits = text.pattern_hits(docs).collect()
    assert any(r.doc_id == 1 and r.position == 0 for r in hits)
    for r in hits:
        body = many if r.doc_id == 2 else phrase + " x" * 500_000
        assert body[r.position : r.position + len(r.matched_text)] == r.matched_text
    assert max(r.nth for r in hits if r.doc_id == 2) >= len(re.findall(phrase, many))


def test_running_totals(spark):
    df = spark.createDataFrame([(list(range(1000)),), ([],), (None,), ([5],)], "xs array<int>")
    got = [r.xs for r in running(df, "xs").collect()]
    assert got == [[sum(range(i + 1)) for i in range(1000)], [], [], [5]]


def test_streams_read_folders(spark, tmp_path):
    spark.range(50).withColumnRenamed("id", "event_id").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    stream = views.table(spark, str(tmp_path), "events", stream=True)
    query = stream.writeStream.format("memory").queryName("folder_rows").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("folder_rows").count() == 50


def test_contamination_on_a_cycle(spark):
    nodes = spark.createDataFrame([(1, 0.0), (2, 0.0), (3, 0.9)], "node_id long, contamination_score double")
    edges = spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "source_id long, target_id long")
    got = provenance.check_contamination(nodes, edges, spark.createDataFrame([(1,)], "start_id long")).first()
    assert (got.contamination_paths, got.total_ancestors) == (1, 2)


def test_registration_keeps_one_row_whatever_the_order(spark):
    rows = [("d", None, "mixed", 0), ("d", None, "augmented", 0)]
    empty = spark.createDataFrame([], "dataset_id string, generation int")
    kinds = set()
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "dataset_id string, parent_id string, source_type string, generation int").repartition(2)
        kinds |= {r.source_type for r in provenance.register(empty, df)[0].collect()}
    assert kinds == {"augmented"}


def test_components_in_many_small_tasks(spark, monkeypatch):
    """A long chain and a large star, contracted a few edges at a time."""
    monkeypatch.setattr(clustering, "_EDGES", 40)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5001)]
    got = clustering.connected_components(spark.createDataFrame(edges, "u long, v long").repartition(7))
    assert {(r.node, r.component) for r in got.collect()} == {
        (n, 0 if n <= 300 else 1000 if n < 5000 else 5000) for e in edges for n in e
    }


def test_clusters_of_text_ids(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    rows = [(0, 10 + i, (rng.normal(size=8) * 0.05 + np.eye(8)[i % 3]).tolist()) for i in range(60)] + [(0, 100, [-1.0] * 8)]
    by_number = {r.vec_id: r.cluster_label for r in clustering.dbscan_cosine(spark.createDataFrame(rows, "batch_id int, vec_id long, embedding array<double>")).collect()}
    named = [(b, f"v{i:04d}", e) for b, i, e in rows]
    by_name = {r.vec_id: r.cluster_label for r in clustering.dbscan_cosine(spark.createDataFrame(named, "batch_id int, vec_id string, embedding array<double>")).collect()}
    assert by_name == {f"v{i:04d}": c for i, c in by_number.items()} and len(set(by_number.values())) == 4


def test_cycles_of_text_ids(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "x"), ("d", "e")]
    got = provenance.find_cycles(spark.createDataFrame(edges, "source_id string, target_id string")).collect()
    assert {(r.node_id, r.cycle_id) for r in got} == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x")}
