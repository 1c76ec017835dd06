"""Dashboard and listing queries with their check SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from sparkpoison.functions import catalogue as cat
from sparkpoison.functions.numeric import round_to
from sparkpoison.operators import dashboard as db, text as tx
from sparkpoison.plans.registry import query
from sparkpoison.plans.views import r
from sparkpoison.sources import for_tenant

_AS_OF = "2024-01-31 00:00:00"
_T = f"TIMESTAMP '{_AS_OF}'"
_THREAT = "coalesce(verdict <> 'clean', false)"
_FMT = "yyyy-MM-dd HH:mm:ss"
_SQLFMT = "'%Y-%m-%d %H:%M:%S'"


@query("P-1 S-1", "scans", "SELECT tenant_id, engine, count(*) AS n FROM scans WHERE tenant_id = 3 GROUP BY ALL")
def tenant_scans(scans: DataFrame) -> DataFrame:
    return for_tenant(scans, 3).groupBy("tenant_id", "engine").agg(F.count("*").alias("n"))


@query("P-2", "scans", f"""
SELECT scan_id, strftime(created_at, {_SQLFMT}) AS created_at, (SELECT count(*) FROM scans) AS total, (SELECT ceil(count(*) / 50.0)::BIGINT FROM scans) AS total_pages
FROM scans ORDER BY scans.created_at DESC, scan_id OFFSET 100 LIMIT 50""")
def listing_page(scans: DataFrame) -> DataFrame:
    out = db.page(scans.select("scan_id", "created_at"), [F.col("created_at").desc(), F.col("scan_id")], 3, 50)
    return out.withColumn("created_at", F.date_format("created_at", _FMT))


@query("P-3", "scans", f"""
SELECT tenant_id, engine, scan_id, risk_score, row_number() OVER (PARTITION BY tenant_id, engine ORDER BY risk_score DESC, scan_id) AS rank FROM scans
WHERE created_at >= {_T} - INTERVAL 240 HOURS QUALIFY rank <= 50""")
def listing_top_per_engine(scans: DataFrame) -> DataFrame:
    return db.top_per_engine(scans, _AS_OF, 240).select("tenant_id", "engine", "scan_id", "risk_score", "rank")


@query("P-4", "alerts", f"""
SELECT alert_id, severity, strftime(created_at, {_SQLFMT}) AS created_at FROM alerts
ORDER BY CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END, alerts.created_at DESC, alert_id LIMIT 800""")
def alerts_recent(alerts: DataFrame) -> DataFrame:
    out = db.recent_alerts(alerts, 800).select("alert_id", "severity", "created_at")
    return out.withColumn("created_at", F.date_format("created_at", _FMT))


@query("P-5", "alerts", """
SELECT tenant_id, count(*) AS total, count_if(severity = 'critical') AS critical, count_if(status = 'open') AS open, count_if(status = 'resolved') AS resolved
FROM alerts GROUP BY tenant_id""")
def alerts_counts(alerts: DataFrame) -> DataFrame:
    return db.alert_counts(alerts)


@query("P-5", "alerts", "SELECT alert_id, severity, status FROM alerts WHERE severity = 'high' AND status = 'open'")
def alerts_filtered(alerts: DataFrame) -> DataFrame:
    return db.recent_alerts(alerts, None, "high", "open").select("alert_id", "severity", "status")


def _hit_counts(column: str) -> str:
    return " UNION ALL ".join(
        "SELECT doc_id, '{}' AS pattern, '{}' AS category, len(regexp_extract_all(text, '{}{}')) AS n FROM docs".format(
            n, k, "(?i)" if fold else "", p.replace("'", "''")) for n, k, _, p, fold in cat.INJECTION_PATTERNS)


@query("P-6 P-7", "docs", f"""
WITH h AS ({_hit_counts("n")})
SELECT pattern, sum(n)::BIGINT AS match_count, strftime(DATE '2024-01-01' + CAST(min(doc_id) AS INTEGER), '%Y-%m-%d') AS first_seen,
  strftime(DATE '2024-01-01' + CAST(max(doc_id) AS INTEGER), '%Y-%m-%d') AS last_seen FROM h WHERE n > 0 AND category = 'prompt_injection' GROUP BY pattern""")
def patterns_seen(docs: DataFrame) -> DataFrame:
    known = db.pattern_catalogue(docs.sparkSession, "prompt_injection").select("pattern")
    day = F.lit("2024-01-01").cast("timestamp") + F.make_interval(days=F.col("doc_id").cast("int"))
    hits = tx.pattern_hits(docs).join(F.broadcast(known), "pattern", "left_semi").withColumn("created_at", day)
    out = db.pattern_rollup(hits)
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("first_seen", "last_seen")})


def _matched() -> str:
    return "list_filter([" + ", ".join(
        "nullif(left(regexp_extract(text, '(?i){}'), 80), '')".format(p.replace("'", "''")) for p in cat.EDGE_INJECTION_PATTERNS) + "], lambda x: x IS NOT NULL)"


@query("P-8", "docs", f"""
WITH m AS (SELECT doc_id, {_matched()} AS f FROM docs), n AS (SELECT * FROM m WHERE len(f) > 0 ORDER BY doc_id DESC LIMIT 20),
e AS (SELECT doc_id, unnest(range(0, len(f))) AS nth, unnest(f) AS snippet FROM n)
SELECT doc_id, nth, snippet FROM e ORDER BY doc_id DESC, nth LIMIT 20""")
def findings_flat(docs: DataFrame) -> DataFrame:
    scans = docs.select(
        "doc_id", tx.first_matches("text", cat.EDGE_INJECTION_PATTERNS).alias("findings"), F.lit(None).cast("double").alias("risk_score"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_interval(days=F.col("doc_id").cast("int"))).alias("created_at"))
    return db.flatten_findings(scans).select("doc_id", "nth", "snippet")


_THREATS = " ".join(f"WHEN '{e}' THEN '{t}'" for e, t in cat.ENGINE_THREATS.items())


@query("P-9", "scans alerts", f"""
WITH j AS (SELECT s.*, severity FROM scans s JOIN alerts a ON a.alert_id = s.scan_id)
SELECT scan_id, CASE engine {_THREATS} END AS threat_type, CASE severity WHEN 'critical' THEN 'critical' WHEN 'high' THEN 'critical' WHEN 'medium' THEN 'warning' ELSE 'info' END AS display_severity,
  CASE WHEN risk_score >= 0.7 THEN 'malicious' WHEN risk_score >= 0.3 THEN 'suspicious' ELSE 'clean' END AS rag_label,
  CASE WHEN floor(risk_score * 100 + 0.5) >= 80 THEN 'critical' WHEN floor(risk_score * 100 + 0.5) >= 50 THEN 'warning' WHEN floor(risk_score * 100 + 0.5) >= 20 THEN 'info' ELSE 'safe' END AS tool_label FROM j""")
def listing_labels(scans: DataFrame, alerts: DataFrame) -> DataFrame:
    rows = scans.join(alerts.select(F.col("alert_id").alias("scan_id"), "severity"), "scan_id")
    return db.relabel(rows).select("scan_id", "threat_type", "display_severity", "rag_label", "tool_label")


@query("P-10", "scans", "SELECT tenant_id, verdict, count(*) AS count FROM scans GROUP BY ALL")
def listing_kpis(scans: DataFrame) -> DataFrame:
    return db.kpi_counts(scans, "verdict")


_SUMMARY = f"""
s AS (SELECT tenant_id, engine, verdict, created_at AS t, {_THREAT} AS th FROM scans),
g AS (SELECT tenant_id, count_if(t >= {_T} - INTERVAL 30 DAYS) AS a, count_if(t >= {_T} - INTERVAL 60 DAYS AND t < {_T} - INTERVAL 30 DAYS) AS b,
  count_if(th AND t >= {_T} - INTERVAL 30 DAYS) AS c, count_if(th AND t >= {_T} - INTERVAL 60 DAYS AND t < {_T} - INTERVAL 30 DAYS) AS d,
  count(DISTINCT CASE WHEN t >= {_T} - INTERVAL 24 HOURS THEN engine END) AS e, count(DISTINCT CASE WHEN t >= {_T} - INTERVAL 48 HOURS AND t < {_T} - INTERVAL 24 HOURS THEN engine END) AS f,
  count_if(th AND t >= {_T} - INTERVAL 24 HOURS) AS g1, count_if(th AND t >= {_T} - INTERVAL 48 HOURS AND t < {_T} - INTERVAL 24 HOURS) AS h,
  count_if(verdict = 'clean' AND t >= {_T} - INTERVAL 30 DAYS) AS i, count_if(verdict IS NOT NULL AND t >= {_T} - INTERVAL 30 DAYS) AS j FROM s GROUP BY tenant_id)"""


@query("B-1", "scans", f"""
WITH {_SUMMARY}
SELECT tenant_id, a AS total_scans, a - b AS total_scans_change, c AS threats_detected, c - d AS threats_change, e AS active_monitors, e - f AS monitors_change,
  {r("g1 / 24.0", 2)} AS threat_velocity, {r("g1 / 24.0::DOUBLE - h / 24.0::DOUBLE", 2)} AS velocity_change, {r("CASE WHEN j > 0 THEN i / j ELSE 0 END * 100", 1)} AS clean_rate FROM g""")
def dashboard_summary(scans: DataFrame) -> DataFrame:
    return db.summary(scans, _AS_OF)


_TIMELINE = f"""
sp AS (SELECT tenant_id, CAST(unnest(generate_series(DATE '2024-01-31' - 14, DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS d FROM (SELECT DISTINCT tenant_id FROM scans)),
dd AS (SELECT tenant_id, CAST(created_at AS DATE) AS d, count(*) AS n, count_if({_THREAT}) AS t FROM scans WHERE created_at >= {_T} - INTERVAL 14 DAYS GROUP BY ALL),
tl AS (SELECT sp.tenant_id, strftime(sp.d, '%Y-%m-%d') AS date, coalesce(n, 0) AS scans, coalesce(t, 0) AS threats FROM sp LEFT JOIN dd ON dd.tenant_id = sp.tenant_id AND dd.d = sp.d)"""


@query("B-2", "scans", f"WITH {_TIMELINE} SELECT * FROM tl")
def dashboard_timeline(scans: DataFrame) -> DataFrame:
    return db.daily_timeline(scans, _AS_OF).withColumn("date", F.date_format("date", "yyyy-MM-dd"))


_LABELS = " ".join(f"WHEN '{e}' THEN '{t}'" for e, t in cat.ENGINE_LABELS.items())
_COLOURS = " ".join(f"WHEN '{e}' THEN '{t}'" for e, t in cat.ENGINE_COLOURS.items())
_BREAKDOWN = f"""
bc AS (SELECT tenant_id, engine, count(*) AS n FROM scans WHERE {_THREAT} AND created_at >= {_T} - INTERVAL 30 DAYS GROUP BY ALL),
bd AS (SELECT tenant_id, engine AS type, CASE engine {_LABELS} END AS label, n AS count, {r("n / sum(n) OVER (PARTITION BY tenant_id) * 100", 1)} AS percentage, CASE engine {_COLOURS} END AS color FROM bc)"""


@query("B-3", "scans", f"WITH {_BREAKDOWN} SELECT * FROM bd")
def dashboard_breakdown(scans: DataFrame) -> DataFrame:
    return db.threat_breakdown(scans, _AS_OF)


@query("B-4", "scans", f"""
WITH s AS (SELECT tenant_id, engine, created_at AS t, {_THREAT} AS th FROM scans WHERE engine <> 'telemetry_simulator'),
g AS (SELECT tenant_id, count_if(engine <> 'provenance_tracker') AS total_scans, count_if(engine <> 'provenance_tracker' AND th) AS threats_detected,
  count_if(engine <> 'provenance_tracker' AND t >= {_T} - INTERVAL 1 HOUR)::DOUBLE AS scan_velocity,
  count_if(th AND engine = 'vector_analyzer' AND t >= {_T} - INTERVAL 24 HOURS) AS vector_poisoning, count_if(th AND engine = 'mcp_auditor' AND t >= {_T} - INTERVAL 24 HOURS) AS mcp_injections,
  count_if(th AND engine = 'rag_detector' AND t >= {_T} - INTERVAL 24 HOURS) AS rag_contamination, count_if(th AND engine = 'provenance_tracker' AND t >= {_T} - INTERVAL 24 HOURS) AS provenance_anomalies,
  strftime(max(CASE WHEN engine <> 'provenance_tracker' THEN t END), {_SQLFMT}) AS last_scan_at FROM s GROUP BY tenant_id)
SELECT *, {r("(total_scans - threats_detected) / total_scans")} AS clean_rate FROM g""")
def dashboard_metrics(scans: DataFrame) -> DataFrame:
    of = lambda e: scans.where(F.col("engine") == e).select("tenant_id", F.col("created_at").alias("at"), db.is_threat().alias("is_threat"))
    out = db.metrics_router(of("vector_analyzer"), of("mcp_auditor"), of("rag_detector"), of("provenance_tracker"), _AS_OF)
    return out.withColumns({"clean_rate": round_to("clean_rate", 6), "last_scan_at": F.date_format("last_scan_at", _FMT)})


@query("B-5", "scans", f"""
SELECT tenant_id, strftime(date_trunc('hour', created_at), {_SQLFMT}) AS bucket, count(*) AS threats FROM scans
WHERE {_THREAT} AND created_at >= {_T} - INTERVAL 240 HOURS GROUP BY ALL""")
def dashboard_hourly(scans: DataFrame) -> DataFrame:
    return db.bucketed(scans, "hour", _AS_OF, 240).withColumn("bucket", F.date_format("bucket", _FMT))


@query("B-6", "scans", f"""
WITH h AS (SELECT engine, least(floor(risk_score * 10), 9) AS bin, count(*) AS n FROM scans GROUP BY ALL)
SELECT e.engine, {r("e.bin / 10.0")} AS range_start, {r("(e.bin + 1) / 10.0")} AS range_end, coalesce(n, 0) AS count
FROM (SELECT engine, unnest(range(0, 10)) AS bin FROM (SELECT DISTINCT engine FROM scans)) e LEFT JOIN h ON h.engine = e.engine AND h.bin = e.bin""")
def dashboard_histogram(scans: DataFrame) -> DataFrame:
    return db.histogram10(scans, "risk_score", ["engine"]).withColumns({c: round_to(c, 6) for c in ("range_start", "range_end")})


@query("B-7", "scans alerts", f"""
WITH {_SUMMARY}, {_TIMELINE}, {_BREAKDOWN},
al AS (SELECT * FROM alerts ORDER BY CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END, alerts.created_at DESC, alert_id LIMIT 8)
SELECT 'summary' AS part, tenant_id, 'total_scans' AS item, a::DOUBLE AS value FROM g UNION ALL SELECT 'summary', tenant_id, 'threats_detected', c FROM g
UNION ALL SELECT 'summary', tenant_id, 'active_monitors', e FROM g
UNION ALL SELECT 'timeline', tenant_id, date || ' scans', scans FROM tl UNION ALL SELECT 'timeline', tenant_id, date || ' threats', threats FROM tl
UNION ALL SELECT 'threat_breakdown', tenant_id, type, count FROM bd UNION ALL SELECT 'threat_breakdown', tenant_id, label, percentage FROM bd
UNION ALL SELECT 'recent_alerts', tenant_id, severity, alert_id FROM al""")
def dashboard_combined(scans: DataFrame, alerts: DataFrame) -> DataFrame:
    """The content of the four parts as (part, tenant, item, value)."""
    parts = db.combined(scans, alerts, _AS_OF)
    date = F.date_format("date", "yyyy-MM-dd")
    items = {
        "summary": [(F.lit(c), F.col(c)) for c in ("total_scans", "threats_detected", "active_monitors")],
        "timeline": [(F.concat(date, F.lit(f" {c}")), F.col(c)) for c in ("scans", "threats")],
        "threat_breakdown": [(F.col("type"), F.col("count")), (F.col("label"), F.col("percentage"))],
        "recent_alerts": [(F.col("severity"), F.col("alert_id"))],
    }
    pair = lambda item, value: F.struct(item.alias("item"), value.cast("double").alias("value"))
    rows = [parts[n].select(F.lit(n).alias("part"), "tenant_id", F.inline(F.array(*[pair(*x) for x in xs]))) for n, xs in items.items()]
    return reduce(DataFrame.unionByName, rows)


_CONN = """
c AS (SELECT CASE s_suppkey % 3 WHEN 0 THEN 'vector_store' WHEN 1 THEN 'mcp_server' ELSE 'rag_pipeline' END AS type,
  CASE s_nationkey % 4 WHEN 0 THEN 'connected' WHEN 1 THEN 'scanning' WHEN 2 THEN 'error' ELSE 'disconnected' END AS status,
  CASE WHEN s_acctbal > 7000 THEN 'malicious' WHEN s_acctbal > 4000 THEN 'suspicious' ELSE 'clean' END AS verdict, s_nationkey AS findings FROM supplier)"""


@query("B-8", "supplier", f"""
WITH {_CONN} SELECT type, count(*) AS total, count_if(status IN ('connected', 'scanning')) AS connected, count_if(verdict <> 'clean') AS active_threats,
  sum(findings)::BIGINT AS findings FROM c GROUP BY type""")
def dashboard_connectors(supplier: DataFrame) -> DataFrame:
    k, n = F.col("s_suppkey") % 3, F.col("s_nationkey") % 4
    rows = supplier.select(
        F.when(k == 0, "vector_store").when(k == 1, "mcp_server").otherwise("rag_pipeline").alias("type"),
        F.when(n == 0, "connected").when(n == 1, "scanning").when(n == 2, "error").otherwise("disconnected").alias("status"),
        F.when(F.col("s_acctbal") > 7000, "malicious").when(F.col("s_acctbal") > 4000, "suspicious").otherwise("clean").alias("verdict"),
        F.col("s_nationkey").alias("findings"))
    return db.connector_rollup(rows)


HISTORY = "hist AS (SELECT scan_id // 3 AS scan_id, tenant_id, engine, verdict, risk_score, created_at FROM scans)"


def history(scans: DataFrame) -> DataFrame:
    """Three consecutive scans read as three states of one scan."""
    return scans.withColumn("scan_id", F.floor(F.col("scan_id") / 3))


ALERTS = f"""
{HISTORY}, hl AS (SELECT *, lag(verdict) OVER (PARTITION BY scan_id ORDER BY created_at) AS b FROM hist),
al AS (SELECT tenant_id, scan_id, CASE verdict WHEN 'poisoned' THEN 'critical' ELSE 'high' END AS severity, engine AS type,
  CASE engine WHEN 'vector_analyzer' THEN 'Vector Analyzer' WHEN 'rag_detector' THEN 'Rag Detector' WHEN 'mcp_auditor' THEN 'Mcp Auditor'
    WHEN 'provenance_tracker' THEN 'Provenance Tracker' ELSE 'Telemetry Simulator' END AS type_label, verdict, risk_score FROM hl
  WHERE verdict IN ('suspicious', 'poisoned') AND verdict IS DISTINCT FROM b),
alerts_out AS (SELECT tenant_id, scan_id, severity, type, type_label, type_label || ' scan returned verdict: ' || verdict || ' (risk score: ' || printf('%.4f', risk_score) || ')' AS message,
  'open' AS status FROM al)"""


@query("B-9", "scans", f"WITH {ALERTS} SELECT * FROM alerts_out")
def alerts_auto(scans: DataFrame) -> DataFrame:
    return db.auto_alerts(history(scans))
