"""Lineage-graph queries with their check SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sparkpoison.functions.numeric import round_to
from sparkpoison.operators import graphs, provenance as pv
from sparkpoison.plans.registry import query
from sparkpoison.plans.views import r


def _all(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("node_id").alias("start_id"))


_UP = """
up AS (SELECT node_id AS start_id, node_id, 0 AS depth, [node_id] AS path FROM nodes
  UNION ALL SELECT start_id, e.source_id, depth + 1, list_append(path, e.source_id) FROM up JOIN edges e ON e.target_id = up.node_id
  WHERE depth < {d} AND NOT list_contains(path, e.source_id))"""
_DOWN = """
down AS (SELECT node_id AS start_id, node_id, 0 AS depth FROM nodes
  UNION ALL SELECT start_id, e.target_id, depth + 1 FROM down JOIN edges e ON e.source_id = down.node_id)"""


@query("G-1", "part", """
WITH RECURSIVE b AS (SELECT p_partkey AS dataset_id, CASE WHEN p_partkey >= 3 THEN p_partkey // 3 END AS parent_id FROM part),
g AS (SELECT dataset_id, parent_id, 0 AS generation FROM b WHERE parent_id IS NULL
  UNION ALL SELECT b.dataset_id, b.parent_id, generation + 1 FROM b JOIN g ON g.dataset_id = b.parent_id)
SELECT g.dataset_id, g.parent_id, CASE p_size % 3 WHEN 0 THEN 'human_curated' WHEN 1 THEN 'synthetic_llm' ELSE 'unknown' END AS source_type, generation
FROM g JOIN part ON p_partkey = g.dataset_id""")
def graph_register(part: DataFrame) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size") % 3
    incoming = part.select(
        k.alias("dataset_id"), F.when(k >= 3, F.floor(k / 3)).alias("parent_id"),
        F.when(s == 0, "human_curated").when(s == 1, "synthetic_llm").otherwise("crawler").alias("source_type"),
        F.lit(None).cast("bigint").alias("generation"))
    return pv.register(incoming.where(F.lit(False)), incoming)[0]


_UPSERT = """
WITH s AS (SELECT node_id AS dataset_id, 'mixed' AS source_type, 1 AS generation, contamination_score FROM nodes WHERE node_id % 2 = 0),
i AS (SELECT node_id AS dataset_id, node_id // 7 AS parent_id, CASE WHEN node_id % 9 = 0 THEN 'scraped' ELSE 'unknown' END AS source_type, node_id % 4 AS generation
  FROM nodes WHERE node_id % 3 = 0),
m AS (SELECT coalesce(s.dataset_id, i.dataset_id) AS dataset_id, coalesce(i.source_type, s.source_type) AS source_type,
  coalesce(i.generation, s.generation) AS generation, CASE WHEN i.dataset_id IS NULL THEN s.contamination_score ELSE 0 END AS contamination_score
  FROM s FULL JOIN i ON i.dataset_id = s.dataset_id),
e AS (SELECT source_id, target_id FROM edges WHERE target_id % 2 = 0
  UNION SELECT parent_id, dataset_id FROM i WHERE parent_id IN (SELECT dataset_id FROM m))"""


def _upserted(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    k = F.col("node_id")
    stored = nodes.where(k % 2 == 0).select(k.alias("dataset_id"), F.lit("mixed").alias("source_type"), F.lit(1).cast("bigint").alias("generation"), "contamination_score")
    incoming = nodes.where(k % 3 == 0).select(
        k.alias("dataset_id"), F.floor(k / 7).alias("parent_id"), F.when(k % 9 == 0, "scraped").otherwise("crawler").alias("source_type"),
        (k % 4).alias("generation"))
    return pv.upsert(stored, edges.where(F.col("target_id") % 2 == 0), incoming)


@query("G-1", "nodes edges", _UPSERT + "SELECT dataset_id, source_type, generation, contamination_score FROM m")
def graph_upsert_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return _upserted(nodes, edges)[0]


@query("G-1", "nodes edges", _UPSERT + "SELECT source_id, target_id FROM e")
def graph_upsert_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return _upserted(nodes, edges)[1]


@query("G-2", "nodes edges", f"""
WITH RECURSIVE {_UP.format(d=10)}
SELECT start_id, node_id, depth, array_to_string(path, '>') AS path, node_type, contamination_score FROM up JOIN nodes USING (node_id)""")
def graph_lineage(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    out = pv.lineage(nodes, edges, _all(nodes), everywhere=True, acyclic=True, text=">")  # links go from smaller to larger ids
    return out.select("start_id", "node_id", "depth", "path", "node_type", "contamination_score")


@query("G-3", "nodes edges", f"""
WITH RECURSIVE {_DOWN}
SELECT start_id, count(*) - 1 AS total_affected, count(DISTINCT node_id) - 1 AS distinct_affected FROM down GROUP BY start_id""")
def graph_blast_radius(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    by_path = pv.blast_radius(edges, _all(nodes), acyclic=True)
    by_node = pv.blast_radius(edges, _all(nodes), distinct=True).withColumnRenamed("total_affected", "distinct_affected")
    return by_path.join(by_node, "start_id")


@query("G-4", "nodes edges", """
WITH RECURSIVE p AS (SELECT target_id AS node_id, max(source_id) AS parent_id FROM edges GROUP BY target_id),
c AS (SELECT node_id AS start_id, 0 AS position, node_id FROM nodes
  UNION ALL SELECT start_id, position + 1, p.parent_id FROM c JOIN p ON p.node_id = c.node_id WHERE position < 19)
SELECT * FROM c""")
def graph_ancestor_chain(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    parents = edges.groupBy(F.col("target_id").alias("node_id")).agg(F.max("source_id").alias("parent_id"))
    return pv.ancestor_chain(nodes.select("node_id").join(parents, "node_id", "left"), _all(nodes))


@query("G-5", "nodes edges", f"""
WITH RECURSIVE {_UP.format(d=20)},
s AS (SELECT up.*, contamination_score AS sc, contamination_score * pow(CAST(0.7 AS DOUBLE), depth) AS de FROM up JOIN nodes USING (node_id) WHERE depth > 0),
g AS (SELECT start_id, count_if(sc > 0) AS cp, max(CASE WHEN sc > 0 THEN de END) AS mx, count(DISTINCT node_id) AS ta FROM s GROUP BY start_id)
SELECT n.node_id AS start_id, coalesce(cp, 0) AS contamination_paths, {r("coalesce(mx, 0)")} AS max_decayed_score, coalesce(mx, 0) > 0.3 AS is_contaminated,
  coalesce(ta, 0) AS total_ancestors FROM nodes n LEFT JOIN g ON g.start_id = n.node_id""")
def graph_contamination(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return pv.check_contamination(nodes, edges, _all(nodes), acyclic=True)  # links go from smaller to larger ids


@query("G-5", "nodes edges", f"""
WITH RECURSIVE {_UP.format(d=20)}
SELECT start_id, node_id AS ancestor_id, contamination_score, array_to_string(path, '>') AS path, depth, {r("contamination_score * pow(CAST(0.7 AS DOUBLE), depth)")} AS decayed_score
FROM up JOIN nodes USING (node_id) WHERE depth > 0 AND contamination_score > 0""")
def graph_contamination_paths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return pv.contamination_paths(nodes, edges, _all(nodes), everywhere=True, acyclic=True, text=">")


def _propagate_sql(passed: str, limit: str) -> str:
    return f"""
WITH RECURSIVE w AS (SELECT node_id AS origin, node_id, 0 AS depth, contamination_score AS s0 FROM nodes WHERE contamination_score > 0
  UNION SELECT origin, e.target_id, depth + 1, s0 FROM w JOIN edges e ON e.source_id = w.node_id WHERE {limit}),
b AS (SELECT node_id, max({passed}) AS score, max(CASE WHEN depth = 0 THEN 1 ELSE 0 END) AS self FROM w GROUP BY node_id),
j AS (SELECT n.node_id, n.contamination_score AS old, score, self FROM nodes n LEFT JOIN b USING (node_id))
SELECT node_id, {r("greatest(old, coalesce(score, 0))")} AS contamination_score, score IS NOT NULL AS is_affected FROM j"""


@query("G-6", "nodes edges", _propagate_sql("s0 * pow(CAST(0.7 AS DOUBLE), depth)", "depth < 20"))
def graph_propagate(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    flagged = nodes.where(F.col("contamination_score") > 0).select("node_id", F.col("contamination_score").alias("score"))
    out = pv.propagate(nodes, edges, flagged)
    return out.select("node_id", round_to("contamination_score", 6).alias("contamination_score"), "is_affected")


@query("G-7", "nodes edges", _propagate_sql("s0 - CAST(0.15 AS DOUBLE) * depth", "s0 - CAST(0.15 AS DOUBLE) * (depth + 1) > 1e-9"))
def graph_propagate_subtractive(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    flagged = nodes.where(F.col("contamination_score") > 0).select("node_id", F.col("contamination_score").alias("score"))
    out = pv.propagate(nodes, edges, flagged, "subtractive")
    return out.select("node_id", round_to("contamination_score", 6).alias("contamination_score"), "is_affected")


_BOTH = """
a AS (SELECT CAST(7 AS BIGINT) AS n, 0 AS d UNION SELECT e.source_id, d + 1 FROM a JOIN edges e ON e.target_id = a.n WHERE d < 10),
b AS (SELECT CAST(7 AS BIGINT) AS n, 0 AS d UNION SELECT e.target_id, d + 1 FROM b JOIN edges e ON e.source_id = b.n WHERE d < 10),
ups AS (SELECT n, -min(d) AS level FROM a GROUP BY n), dn AS (SELECT n, min(d) AS level FROM b GROUP BY n HAVING min(d) > 0)"""


@query("G-8", "nodes edges", f"WITH RECURSIVE {_BOTH} SELECT n AS node_id, level FROM ups UNION ALL SELECT n, level FROM dn")
def graph_neighbourhood_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return pv.lineage_graph(edges, 7)[0]


@query("G-8", "nodes edges", f"""
WITH RECURSIVE {_BOTH}
SELECT source_id, target_id FROM edges WHERE source_id IN (SELECT n FROM ups) AND (target_id IN (SELECT n FROM ups) OR target_id IN (SELECT n FROM dn))
UNION SELECT source_id, target_id FROM edges WHERE target_id IN (SELECT n FROM dn)""")
def graph_neighbourhood_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return pv.lineage_graph(edges, 7)[1]


@query("G-9", "cyclic_edges", """
WITH RECURSIVE w AS (SELECT source_id AS s, target_id AS n FROM cyclic_edges
  UNION SELECT w.s, e.target_id FROM w JOIN cyclic_edges e ON e.source_id = w.n),
c AS (SELECT s FROM w WHERE s = n)
SELECT a.s AS node_id, min(b.s) AS cycle_id FROM c a JOIN w ON w.s = a.s JOIN c b ON b.s = w.n GROUP BY a.s""")
def graph_cycles(cyclic_edges: DataFrame) -> DataFrame:
    return pv.find_cycles(cyclic_edges)


@query("G-10", "nodes edges", """
WITH RECURSIVE w AS (SELECT node_id AS start_id, node_id FROM nodes WHERE contamination_score > 0
  UNION SELECT start_id, e.target_id FROM w JOIN edges e ON e.source_id = w.node_id)
SELECT start_id, count(*) AS reached FROM w GROUP BY start_id""")
def graph_reachable(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    dirty = _all(nodes.where(F.col("contamination_score") > 0))
    reached = graphs.reach_counts(edges, "down").withColumnRenamed("node_id", "start_id")
    return dirty.join(reached, "start_id", "left").select("start_id", (F.coalesce("reached", F.lit(0)) + 1).alias("reached"))


@query("G-11", "nodes", """
SELECT node_type, count(*) AS count, count_if(contamination_score >= 0.7) AS poisoned, count_if(contamination_score >= 0.3 AND contamination_score < 0.7) AS suspicious,
  count_if(contamination_score < 0.3) AS clean FROM nodes GROUP BY node_type""")
def graph_stats(nodes: DataFrame) -> DataFrame:
    s = F.col("contamination_score")
    verdict = F.when(s >= 0.7, "poisoned").when(s >= 0.3, "suspicious").otherwise("clean")
    return pv.graph_stats(nodes.withColumn("verdict", verdict))


@query("G-12", "nodes edges", """
WITH RECURSIVE t AS (SELECT e.*, CASE WHEN n.node_type IN ('model', 'deployment') THEN 1 ELSE 0 END AS tr FROM edges e JOIN nodes n ON n.node_id = e.target_id),
d AS (SELECT node_id AS s, node_id AS n, 0 AS h FROM nodes WHERE contamination_score > 0
  UNION SELECT s, t.target_id, h + 1 FROM d JOIN t ON t.source_id = d.n WHERE tr = 0 AND h < 5),
m AS (SELECT s, n, 0 AS h FROM (SELECT DISTINCT s, n FROM d) UNION SELECT s, t.target_id, h + 1 FROM m JOIN t ON t.source_id = m.n WHERE tr = 1 AND h < 5)
SELECT DISTINCT s AS start_id, n AS model_id FROM m JOIN nodes ON node_id = n WHERE h > 0 AND node_type = 'model'""")
def graph_affected_models(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    kinds = nodes.select(F.col("node_id").alias("target_id"), F.when(F.col("node_type").isin("model", "deployment"), "trained_on").otherwise("derived_from").alias("edge_type"))
    return pv.affected_models(nodes, edges.join(kinds, "target_id"), _all(nodes.where(F.col("contamination_score") > 0)))


@query("G-13", "lineitem part supplier", f"""
WITH c AS (SELECT l_partkey AS source_id, l_suppkey AS target_id, l_discount * 10 AS probability, l_shipdate AS detected_at FROM lineitem
  WHERE l_shipdate >= TIMESTAMP '1997-01-01' ORDER BY detected_at DESC, source_id, target_id, probability DESC LIMIT 50)
SELECT source_id, p_name AS source_name, target_id, s_name AS target_name, {r("probability")} AS probability, strftime(detected_at, '%Y-%m-%d') AS detected_at
FROM c JOIN part ON p_partkey = source_id JOIN supplier ON s_suppkey = target_id""")
def graph_recent_contamination(lineitem: DataFrame, part: DataFrame, supplier: DataFrame) -> DataFrame:
    edges = lineitem.select(F.col("l_partkey").alias("source_id"), F.col("l_suppkey").alias("target_id"),
                            (F.col("l_discount") * 10).alias("probability"), F.col("l_shipdate").alias("detected_at"))
    out = pv.recent_contamination(
        edges, part.select(F.col("p_partkey").alias("source_id"), F.col("p_name").alias("source_name")),
        supplier.select(F.col("s_suppkey").alias("target_id"), F.col("s_name").alias("target_name")), "1997-01-01")
    return out.withColumns({"probability": round_to("probability", 6), "detected_at": F.date_format("detected_at", "yyyy-MM-dd")})


@query("G-14", "nodes edges", """
WITH RECURSIVE w AS (SELECT CAST(1 AS BIGINT) AS n, [CAST(1 AS BIGINT)] AS path UNION ALL
  SELECT e.target_id, list_append(path, e.target_id) FROM w JOIN edges e ON e.source_id = w.n WHERE len(path) <= 20),
t AS (SELECT path FROM w WHERE n = (SELECT max(node_id) FROM nodes) ORDER BY len(path), path LIMIT 1)
SELECT unnest(range(0, len(path))) AS hop, unnest(path) AS node_id FROM t""")
def graph_shortest_path(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return pv.shortest_path(edges, 1, nodes.agg(F.max("node_id")).first()[0])


@query("G-15", "nodes edges", """
SELECT node_id, direction, neighbour_id FROM nodes LEFT JOIN (SELECT target_id AS node_id, 'parent' AS direction, source_id AS neighbour_id FROM edges
  UNION ALL SELECT source_id, 'child', target_id FROM edges) USING (node_id)""")
def graph_adjacency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return pv.adjacency(nodes, edges)


_GEN = "g AS (SELECT *, contamination_score > 0.3 AS bad, CAST(floor(log2(node_id + 1)) AS BIGINT) AS generation FROM nodes)"


def _with_generation(nodes: DataFrame) -> DataFrame:
    return nodes.withColumns({
        "is_contaminated": F.col("contamination_score") > 0.3, "generation": F.floor(F.log2(F.col("node_id") + 1)).cast("bigint"),
        "registered_at": F.lit("2024-01-01").cast("timestamp") + F.make_interval(days=F.col("node_id").cast("int"))})


@query("G-16", "nodes", f"""
WITH {_GEN} SELECT tenant_id, bool_or(bad) AS is_contaminated, {r("coalesce(avg(CASE WHEN bad THEN contamination_score END), 0)")} AS contamination_score,
  count_if(bad) AS affected_nodes, coalesce(max(CASE WHEN bad THEN generation END), 0) AS traceback_depth,
  strftime(min(CASE WHEN bad THEN DATE '2024-01-01' + CAST(node_id AS INTEGER) END), '%Y-%m-%d') AS detected_at FROM g GROUP BY tenant_id""")
def graph_contamination_status(nodes: DataFrame) -> DataFrame:
    out = pv.contamination_status(_with_generation(nodes))
    return out.withColumns({"contamination_score": round_to("contamination_score", 6), "detected_at": F.date_format("detected_at", "yyyy-MM-dd")})


@query("G-17", "nodes", f"""
WITH {_GEN} SELECT generation, count(*) AS nodes, count_if(bad) AS contaminated, {r("count_if(bad) / count(*)")} AS share FROM g GROUP BY generation""")
def graph_by_generation(nodes: DataFrame) -> DataFrame:
    return pv.by_generation(_with_generation(nodes)).withColumn("share", round_to("share", 6))
