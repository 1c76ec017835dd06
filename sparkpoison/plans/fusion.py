"""Threat-fusion queries with their check SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sparkpoison.functions import catalogue as cat
from sparkpoison.functions.numeric import round_to
from sparkpoison.operators import fusion as fu
from sparkpoison.plans.registry import query
from sparkpoison.plans.views import r

# The engines' results, taken from the scans view: one scan is one finding of its engine.
_RESULTS = """
res AS (SELECT scan_id, tenant_id, created_at, risk_score AS score, verdict,
  CASE engine WHEN 'rag_detector' THEN 'rag_analyzer' ELSE engine END AS engine FROM scans WHERE engine <> 'telemetry_simulator'),
thr AS (SELECT *, CASE engine WHEN 'vector_analyzer' THEN 0 WHEN 'rag_analyzer' THEN 1 WHEN 'mcp_auditor' THEN 2 ELSE 3 END AS o FROM res
  WHERE (engine = 'vector_analyzer' AND score > 0.3) OR (engine = 'rag_analyzer' AND score > 0.5) OR (engine = 'mcp_auditor' AND score > 0.2)
     OR (engine = 'provenance_tracker' AND score > 0.3)),
sev AS (SELECT *, CASE WHEN score >= 0.85 THEN 'critical' WHEN score >= 0.6 THEN 'high' WHEN score >= 0.35 THEN 'medium' ELSE 'low' END AS severity FROM thr)"""
_ACTION = "CASE engine " + " ".join(f"WHEN '{e}' THEN '{a}'" for e, a in cat.ENGINE_ACTIONS.items()) + " END"
_WEIGHT = "CAST(CASE engine " + " ".join(f"WHEN '{e}' THEN {w}" for e, w in cat.ENGINE_WEIGHTS.items()) + " END AS DOUBLE)"


def _scores(scans: DataFrame) -> DataFrame:
    engine = F.when(F.col("engine") == "rag_detector", "rag_analyzer").otherwise(F.col("engine"))
    return scans.where(F.col("engine") != "telemetry_simulator").select("scan_id", "tenant_id", engine.alias("engine"), F.col("risk_score").alias("score"), "verdict")


def _threats(scans: DataFrame) -> DataFrame:
    res = _scores(scans)
    of = lambda e: res.where(F.col("engine") == e)
    return fu.unify_threats(
        of("vector_analyzer").select("tenant_id", F.col("scan_id").alias("vec_id"), F.col("score").alias("anomaly_score"),
                                     F.lit(None).cast("double").alias("cosine_deviation"), F.array(F.lit("far"), F.lit("noise")).alias("reasons")),
        of("rag_analyzer").select("tenant_id", F.col("scan_id").alias("doc_id"), F.col("score").alias("risk_score"), (F.col("score") > 0.5).alias("is_suspicious"),
                                  F.array(F.lit("homoglyphs"), F.lit("low_coherence")).alias("signals"), (F.col("scan_id") % 3).alias("hidden")),
        of("mcp_auditor").select("tenant_id", F.col("scan_id").alias("tool_id"), F.concat(F.lit("tool_"), F.col("scan_id").cast("string")).alias("tool_name"),
                                 F.col("score").alias("risk_score"), F.coalesce("verdict", F.lit("none")).alias("verdict"), (F.col("scan_id") % 5).alias("findings")),
        of("provenance_tracker").select("tenant_id", F.col("scan_id").alias("dataset_id"), F.col("score").alias("max_decayed_score"),
                                        (F.col("score") > 0.3).alias("is_contaminated"), (F.col("scan_id") % 4).alias("paths")),
    )


@query("A-1 A-3", "scans", f"""
WITH {_RESULTS}, n AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY o, scan_id) AS k FROM sev)
SELECT tenant_id, CASE o WHEN 0 THEN 'VEC' WHEN 1 THEN 'RAG' WHEN 2 THEN 'MCP' ELSE 'PRV' END || '-' || printf('%04d', k) AS threat_id, engine AS source_engine,
  CAST(scan_id AS VARCHAR) AS entity_id, CASE o WHEN 0 THEN 'vector_poisoning' WHEN 1 THEN CASE WHEN scan_id % 3 > 0 THEN 'prompt_injection' ELSE 'rag_injection' END
    WHEN 2 THEN 'mcp_tool_attack' ELSE 'data_contamination' END AS category, severity, score,
  CASE o WHEN 0 THEN 'Anomalous embedding vector (index ' || scan_id || ')' WHEN 1 THEN 'Suspicious RAG document detected'
    WHEN 2 THEN 'Suspicious MCP tool: tool_' || scan_id ELSE 'Contaminated dataset: ' || scan_id END AS title,
  CASE o WHEN 0 THEN 'far; noise' WHEN 1 THEN 'Triggered signals: homoglyphs, low_coherence'
    WHEN 2 THEN 'Verdict: ' || coalesce(verdict, 'none') || '. ' || (scan_id % 5) || ' finding(s).' ELSE (scan_id % 4) || ' contamination path(s) detected in ancestry.' END AS description,
  CASE o WHEN 0 THEN 'cosine_deviation=N/A' WHEN 1 THEN 'hidden_instructions=' || (scan_id % 3) WHEN 2 THEN 'tool=tool_' || scan_id ELSE 'dataset=' || scan_id END AS evidence,
  {_ACTION} AS recommended_action FROM n""")
def threat_unified(scans: DataFrame) -> DataFrame:
    return _threats(scans)


@query("A-2 A-3", "scans", f"""
WITH {_RESULTS}, t AS (SELECT tenant_id, engine, max(score) AS m FROM res GROUP BY ALL),
u AS (SELECT tenant_id, least(sum({_WEIGHT} * m), 1.0) AS s FROM t GROUP BY tenant_id)
SELECT tenant_id, {r("s", 4)} AS unified_score, CASE WHEN s >= 0.8 THEN 'critical' WHEN s >= 0.55 THEN 'high' WHEN s >= 0.3 THEN 'medium' ELSE 'low' END AS severity FROM u""")
def threat_unified_score(scans: DataFrame) -> DataFrame:
    return fu.unified_score(_scores(scans))


@query("A-4", "scans", f"""
WITH {_RESULTS}, e AS (SELECT tenant_id, engine, max(score) AS m FROM res GROUP BY ALL),
c AS (SELECT tenant_id, engine, count(*) AS n, count_if(severity = 'critical') AS cr, count_if(severity = 'high') AS hi FROM sev GROUP BY ALL),
g AS (SELECT tenant_id, unnest(['vector_analyzer','rag_analyzer','mcp_auditor','provenance_tracker']) AS engine FROM (SELECT DISTINCT tenant_id FROM res))
SELECT tenant_id, engine, coalesce(n, 0) AS finding_count, coalesce(cr, 0) AS critical_count, coalesce(hi, 0) AS high_count, {r("coalesce(m, 0)", 4)} AS max_score,
  {r(f"{_WEIGHT} * coalesce(m, 0)", 4)} AS weighted_contribution FROM g LEFT JOIN e USING (tenant_id, engine) LEFT JOIN c USING (tenant_id, engine)""")
def threat_engine_summaries(scans: DataFrame) -> DataFrame:
    return fu.engine_summaries(_scores(scans), _threats(scans))


@query("A-5", "scans", f"""
WITH w AS (SELECT scan_id, tenant_id, risk_score AS score, avg(risk_score) OVER o AS m, count(*) OVER o AS n FROM scans
  WINDOW o AS (PARTITION BY tenant_id ORDER BY created_at, scan_id ROWS BETWEEN 29 PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, {r("(score - m) / m", 9)} AS ch FROM w)
SELECT scan_id, tenant_id, CASE WHEN n < 2 THEN 'insufficient_data' WHEN m < 1e-6 THEN CASE WHEN score < 0.05 THEN 'stable' ELSE 'degrading' END
  WHEN ch < -0.1 THEN 'improving' WHEN ch > 0.1 THEN 'degrading' ELSE 'stable' END AS trend FROM c""")
def threat_trend(scans: DataFrame) -> DataFrame:
    history = scans.select("scan_id", "tenant_id", F.col("created_at").alias("at"), F.col("risk_score").alias("score"))
    return fu.trend(history).select("scan_id", "tenant_id", "trend")


@query("A-6", "scans", f"""
WITH {_RESULTS}, b AS (SELECT tenant_id, o, {_ACTION} AS action, max(score) AS s FROM sev GROUP BY ALL
  UNION ALL SELECT DISTINCT tenant_id, -1, '{cat.INCIDENT_ACTION}', 9.0 FROM sev WHERE severity = 'critical')
SELECT tenant_id, row_number() OVER (PARTITION BY tenant_id ORDER BY s DESC, o) AS priority, action FROM b""")
def threat_recommendations(scans: DataFrame) -> DataFrame:
    return fu.recommendations(_threats(scans))


_AS_OF = "2024-01-31 00:00:00"
_EDGE = f"""
rec AS (SELECT tenant_id, CASE engine WHEN 'vector_analyzer' THEN 'vector' WHEN 'rag_detector' THEN 'rag' ELSE 'mcp' END AS engine, risk_score, verdict, created_at
  FROM scans WHERE engine IN ('vector_analyzer', 'rag_detector', 'mcp_auditor') AND created_at >= TIMESTAMP '{_AS_OF}' - INTERVAL 240 HOURS),
top AS (SELECT * FROM rec QUALIFY row_number() OVER (PARTITION BY tenant_id, engine ORDER BY risk_score DESC, created_at DESC, verdict NULLS FIRST) <= 50),
con AS (SELECT tenant_id, CASE verdict WHEN 'poisoned' THEN 'critical' WHEN 'suspicious' THEN 'medium' ELSE 'low' END AS severity, created_at FROM scans
  WHERE engine = 'provenance_tracker' AND created_at >= TIMESTAMP '{_AS_OF}' - INTERVAL 240 HOURS
  QUALIFY row_number() OVER (PARTITION BY tenant_id ORDER BY created_at DESC, severity) <= 50),
sc AS (SELECT tenant_id, engine, coalesce(avg(CASE WHEN risk_score >= 0.3 THEN risk_score END), 0) AS score, count(*) AS n, count_if(verdict IS DISTINCT FROM 'clean') AS f FROM top GROUP BY ALL
  UNION ALL SELECT tenant_id, 'provenance', avg(CASE severity WHEN 'critical' THEN 0.9::DOUBLE WHEN 'high' THEN 0.7::DOUBLE WHEN 'medium' THEN 0.5::DOUBLE ELSE 0.2::DOUBLE END), count(*),
    count_if(severity IN ('critical', 'high')) FROM con GROUP BY tenant_id),
rep AS (SELECT g.tenant_id, g.engine, coalesce(score, 0) AS score, coalesce(n, 0) AS record_count, coalesce(f, 0) AS flagged_count
  FROM (SELECT tenant_id, unnest(['vector', 'rag', 'mcp', 'provenance']) AS engine FROM (SELECT DISTINCT tenant_id FROM scans)) g LEFT JOIN sc USING (tenant_id, engine)),
repv AS (SELECT *, CASE WHEN engine = 'mcp' THEN CASE WHEN score >= 0.5 THEN 'malicious' WHEN score >= 0.2 THEN 'suspicious' ELSE 'clean' END
  WHEN score >= 0.6 THEN CASE WHEN engine = 'provenance' THEN 'contaminated' ELSE 'poisoned' END WHEN score >= 0.3 THEN 'suspicious' ELSE 'clean' END AS verdict FROM rep)"""


def _edge_report(scans: DataFrame) -> DataFrame:
    short = F.when(F.col("engine") == "vector_analyzer", "vector").when(F.col("engine") == "rag_detector", "rag").otherwise("mcp")
    records = scans.where(F.col("engine").isin("vector_analyzer", "rag_detector", "mcp_auditor")).withColumn("engine", short)
    severity = F.when(F.col("verdict") == "poisoned", "critical").when(F.col("verdict") == "suspicious", "medium").otherwise("low")
    nodes = scans.where(F.col("engine") == "provenance_tracker").select("tenant_id", severity.alias("severity"), "created_at")
    return fu.threat_report_edge(records, nodes, _AS_OF, 240)


@query("A-7 P-3", "scans", f"WITH {_EDGE} SELECT tenant_id, engine, {r('score')} AS score, record_count, flagged_count, verdict FROM repv")
def threat_report_edge(scans: DataFrame) -> DataFrame:
    return _edge_report(scans).withColumn("score", round_to("score", 6))


@query("A-7", "scans", f"""
WITH {_EDGE}, u AS (SELECT tenant_id, sum(score * CASE engine WHEN 'vector' THEN 0.3::DOUBLE WHEN 'provenance' THEN 0.2::DOUBLE ELSE 0.25::DOUBLE END) AS s FROM rep GROUP BY tenant_id)
SELECT tenant_id, {r("s", 4)} AS unified_score, CASE WHEN s >= 0.8 THEN 'critical' WHEN s >= 0.55 THEN 'high' WHEN s >= 0.3 THEN 'medium' ELSE 'low' END AS severity FROM u""")
def threat_score_edge(scans: DataFrame) -> DataFrame:
    return fu.threat_score_edge(_edge_report(scans))


def _rules_sql() -> str:
    rows = ", ".join("('{}', {}::DOUBLE, {}::DOUBLE, {}, '{}')".format(e, lo, hi, k, t.replace("'", "''")) for e, lo, hi, k, t in cat.EDGE_RECOMMENDATIONS)
    return f"rules(engine, low, high, part, recommendation) AS (VALUES {rows})"


@query("A-8", "scans", f"""
WITH {_EDGE}, {_rules_sql()}
SELECT DISTINCT tenant_id, engine, part, recommendation FROM rep JOIN rules USING (engine) WHERE score >= low AND score < high""")
def threat_recommendations_edge(scans: DataFrame) -> DataFrame:
    return fu.recommendations_edge(_edge_report(scans))


@query("A-9", "scans", f"""
WITH x AS (SELECT * FROM scans WHERE created_at >= TIMESTAMP '{_AS_OF}' - INTERVAL 240 HOURS),
e AS (SELECT tenant_id, engine, count(*) AS n FROM x GROUP BY ALL),
m AS (SELECT tenant_id, string_agg(engine || '=' || n, ',' ORDER BY engine) AS by_type FROM e GROUP BY tenant_id)
SELECT x.tenant_id, count(*) AS total, count_if(verdict = 'clean') AS clean, count_if(verdict = 'suspicious') AS suspicious, count_if(verdict = 'poisoned') AS poisoned, by_type
FROM x JOIN m USING (tenant_id) GROUP BY ALL""")
def threat_scan_summary(scans: DataFrame) -> DataFrame:
    out = fu.scan_summary(scans, _AS_OF, 240)
    pairs = F.transform(F.map_entries("by_type"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return out.withColumn("by_type", F.array_join(F.array_sort(pairs), ","))
