"""Graph algorithms against plain Python on acyclic, cyclic and very long graphs."""

import random

import pytest

from sparkpoison.operators import graphs, provenance as pv


def simple_paths(out, start, most):
    """(end, length) of every simple path of 1 to ``most`` edges."""
    found, stack = [], [(start, (start,))]
    while stack:
        node, path = stack.pop()
        for v in out.get(node, ()):
            if v not in path and len(path) <= most:
                found.append((v, len(path)))
                stack.append((v, path + (v,)))
    return found


def links(edges, up=False):
    out = {}
    for a, b in set(edges):
        out.setdefault(b if up else a, []).append(a if up else b)
    return out


def graph(spark, edges):
    return spark.createDataFrame(edges, "source_id long, target_id long")


def made(seed, n, m, cyclic):
    rng = random.Random(seed)
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
    return edges if cyclic else [(min(e), max(e)) for e in edges if e[0] != e[1]]


CYCLIC = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 4), (2, 5), (6, 7), (7, 8), (8, 9), (9, 10), (0, 1), (7, 7), (11, 12), (12, 11), (12, 9)]


@pytest.mark.parametrize("edges", [CYCLIC, made(1, 14, 24, True), made(2, 30, 45, False)], ids=["loops", "random", "acyclic"])
def test_totals_without_listing(spark, edges):
    nodes = sorted({n for e in edges for n in e} | {99})
    starts = spark.createDataFrame([(n,) for n in nodes], "start_id long")
    df = graph(spark, edges)
    down, up = links(edges), links(edges, True)
    got = {r.start_id: r.total_affected for r in pv.blast_radius(df, starts).collect()}
    assert got == {n: len(simple_paths(down, n, 99)) for n in nodes}
    got = {r.start_id: r.total_affected for r in pv.blast_radius(df, starts, distinct=True).collect()}
    assert got == {n: len({v for v, _ in simple_paths(down, n, 99)}) for n in nodes}
    score = {n: 0.9 if n % 5 == 0 else 0.4 if n % 3 == 0 else 0.0 for n in nodes}
    scored = spark.createDataFrame(list(score.items()), "node_id long, contamination_score double")
    for row in pv.check_contamination(scored, df, starts, max_depth=4).collect():
        seen = simple_paths(up, row.start_id, 4)
        dirty = [score[v] * 0.7**d for v, d in seen if score[v] > 0]
        assert (row.contamination_paths, row.total_ancestors) == (len(dirty), len({v for v, _ in seen}))
        assert row.max_decayed_score == pytest.approx(max(dirty, default=0), abs=1e-6)


def test_paths_by_doubling(spark):
    for edges in (CYCLIC, made(3, 12, 20, False)):
        df, starts = graph(spark, edges), spark.createDataFrame([(1,), (7,), (50,)], "start_id long")
        level = sorted(map(tuple, pv.paths(df, starts, "down", 5).collect()))
        assert level == sorted(map(tuple, pv.paths(df, starts, "down", 5, everywhere=True).collect()))


def strongly_connected(edges):
    out = links(edges)
    reach = {}
    for n in {x for e in edges for x in e}:
        seen, stack = set(), [n]
        while stack:
            for v in out.get(stack.pop(), ()):
                if v not in seen:
                    seen.add(v)
                    stack.append(v)
        reach[n] = seen
    return {n: min([m for m in reach[n] if n in reach[m]]) for n in reach if n in reach[n]}


@pytest.mark.parametrize("seed", range(4))
def test_loops(spark, seed):
    rng = random.Random(seed)
    edges = made(seed, 40, 44, True)
    at = 100
    for _ in range(6):  # chains and rings hung between the random nodes
        chain = [rng.randrange(40), *range(at, at + rng.randint(1, 9)), rng.randrange(40)]
        edges += list(zip(chain, chain[1:]))
        at += 20
    ring = list(range(500, 512))
    edges += list(zip(ring, ring[1:] + ring[:1])) + [(600, 600), (601, 602)]
    assert {r.node_id: r.cycle_id for r in pv.find_cycles(graph(spark, edges)).collect()} == strongly_connected(edges)


def test_a_long_chain_takes_few_jobs(spark):
    n = 100_000
    df = spark.range(n).selectExpr("id AS source_id", f"CASE WHEN id = {n - 1} THEN {n - 5} ELSE id + 1 END AS target_id")
    spark.sparkContext.setJobGroup("long-chain", "loop at the end of a chain")
    try:
        got = {r.node_id: r.cycle_id for r in pv.find_cycles(df).collect()}
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("long-chain"))
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert got == {i: n - 5 for i in range(n - 5, n)}
    assert jobs <= 60
    chain = spark.range(3000).selectExpr("id AS source_id", "id + 1 AS target_id")
    total = pv.blast_radius(chain, spark.createDataFrame([(0,), (2990,), (3000,)], "start_id long"), acyclic=True)
    assert {r.start_id: r.total_affected for r in total.collect()} == {0: 3000, 2990: 10, 3000: 0}


def test_reach_by_sketch(spark):
    edges = [(0, i) for i in range(1, 3000)] + [(3000, 0)]
    got = {r.node_id: r.reached for r in graphs.reach_counts(graph(spark, edges), sketch=True).collect()}
    assert got[0] == pytest.approx(2999, rel=0.06) and got[3000] == pytest.approx(3000, rel=0.06)


def test_registration_follows_long_chains(spark):
    stored = spark.createDataFrame([("s", 4)], "dataset_id string, generation int")
    rows = [("a0", None, "mixed", 7), ("b0", "s", "other", None), ("x", "nowhere", "mixed", 1), ("y", "x", "mixed", 1), ("p", "q", "mixed", 0), ("q", "p", "mixed", 0)]
    rows += [(f"a{i}", f"a{i - 1}", "scraped", None) for i in range(1, 200)] + [("b1", "b0", "mixed", 0)]
    df = spark.createDataFrame(rows, "dataset_id string, parent_id string, source_type string, generation int")
    nodes, edges, rejected = pv.register(stored, df)
    got = {r.dataset_id: (r.generation, r.source_type) for r in nodes.collect()}
    assert got == {"a0": (7, "mixed"), "b0": (5, "unknown"), "b1": (6, "mixed")} | {f"a{i}": (7 + i, "scraped") for i in range(1, 200)}
    assert {r.dataset_id for r in rejected.collect()} == {"x", "y", "p", "q"} and edges.count() == 201


def test_upsert_keeps_parents_and_cleans(spark):
    stored = spark.createDataFrame([("a", "mixed", 0, 0.8, "t"), ("b", "mixed", 1, 0.5, "t")], "dataset_id string, source_type string, generation int, contamination_score double, owner string")
    edges = spark.createDataFrame([("a", "b")], "source_id string, target_id string")
    rows = [("b", "c", "scraped", 3), ("b", "a", "scraped", 2), ("c", None, "odd", 0), ("d", "gone", "mixed", 1), (None, "a", "mixed", 1), ("", "a", "mixed", 1), ("c", None, "odd", 0)]
    incoming = spark.createDataFrame(rows, "dataset_id string, parent_id string, source_type string, generation int")
    nodes, links_ = pv.upsert(stored, edges, incoming)
    assert sorted(map(tuple, nodes.collect())) == [
        ("a", "mixed", 0, 0.8, "t"), ("b", "scraped", 2, 0.0, "t"), ("c", "unknown", 0, 0.0, None), ("d", "mixed", 1, 0.0, None)]
    assert sorted(map(tuple, links_.collect())) == [("a", "b"), ("c", "b")]
    again = pv.upsert(nodes, links_, incoming)
    assert sorted(map(tuple, again[0].collect())) == sorted(map(tuple, nodes.collect())) and again[1].count() == 2
