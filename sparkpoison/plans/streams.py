"""Streaming queries over the test tables, and sinks read back, with their check SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from sparkpoison.functions.numeric import round_to
from sparkpoison.plans import dashboard as dash, drift as dplan
from sparkpoison.plans.registry import query
from sparkpoison.plans.views import r
from sparkpoison.session import shared_dir
from sparkpoison.sources import tables as tb
from sparkpoison.sources.streams import run_available
from sparkpoison.streaming import detect as st

_FMT = "yyyy-MM-dd HH:mm:ss"
_SQLFMT = "'%Y-%m-%d %H:%M:%S'"


def _folder(df: DataFrame, name: str) -> str:
    return f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"


@query("W-1", "ml", f"WITH {dplan._ML} SELECT inference_id, is_anomalous, anomaly_score FROM mln", stream=True)
def stream_ml_ingest(ml: DataFrame) -> DataFrame:
    return run_available(st.stream_ingest(ml, "ml").select("inference_id", "is_anomalous", "anomaly_score"))


@query("W-2", "spans", f"""
SELECT strftime(to_timestamp(epoch_us(ts) // 60000000 * 60) AT TIME ZONE 'UTC', {_SQLFMT}) AS start, count(DISTINCT agent_id) AS agents, count(*) AS spans
FROM spans WHERE risk_score > 0.65 OR memory_corrupted GROUP BY 1 HAVING count(DISTINCT agent_id) >= 3""", stream=True)
def stream_collusion_minutes(spans: DataFrame) -> DataFrame:
    marked = spans.withColumn("is_anomalous", (F.col("risk_score") > 0.65) | F.col("memory_corrupted"))
    return run_available(st.stream_collusion(marked), "complete").withColumn("start", F.date_format("start", _FMT))


@query("W-3", "scans", f"""
WITH w AS (SELECT tenant_id, unnest(generate_series(0, 23)) AS k, epoch_us(created_at) // 3600000000 AS h, coalesce(verdict <> 'clean', false) AS t FROM scans)
SELECT tenant_id, strftime(to_timestamp((h - k) * 3600) AT TIME ZONE 'UTC', {_SQLFMT}) AS start, count(*) AS scans, count_if(t) AS threats FROM w GROUP BY tenant_id, h - k""", stream=True)
def stream_scan_velocity(scans: DataFrame) -> DataFrame:
    return run_available(st.stream_velocity(scans), "complete").withColumn("start", F.date_format("start", _FMT))


@query("W-4", "scans", f"WITH {dash.ALERTS} SELECT * FROM alerts_out", stream=True)
def stream_verdict_alerts(scans: DataFrame) -> DataFrame:
    return run_available(st.stream_auto_alert(dash.history(scans)))


@query("W-5", "scans", f"""
WITH w AS (SELECT scan_id, tenant_id, risk_score AS score, avg(risk_score) OVER o AS m, count(*) OVER o AS n FROM scans
  WINDOW o AS (PARTITION BY tenant_id ORDER BY created_at, scan_id ROWS BETWEEN 29 PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, {r("(score - m) / m", 9)} AS ch FROM w)
SELECT scan_id AS record_id, tenant_id, CASE WHEN n < 2 THEN 'insufficient_data' WHEN m < 1e-6 THEN CASE WHEN score < 0.05 THEN 'stable' ELSE 'degrading' END
  WHEN ch < -0.1 THEN 'improving' WHEN ch > 0.1 THEN 'degrading' ELSE 'stable' END AS trend FROM c""", stream=True)
def stream_score_trend(scans: DataFrame) -> DataFrame:
    history = scans.select("tenant_id", F.col("scan_id").alias("record_id"), F.col("created_at").alias("at"), F.col("risk_score").alias("score"))
    return run_available(st.stream_trend(history))


@query("W-6", "llm", f"""
WITH {dplan._LLM}, g AS (SELECT tenant_id, application_id, avg(poisoning_risk) AS s, count_if(poisoning_risk > 0.3) AS f FROM lln GROUP BY ALL)
SELECT tenant_id, application_id, {r("s", 4)} AS risk_score, f AS findings_count FROM g WHERE s > 0.3""", stream=True)
def stream_auto_scans(llm: DataFrame) -> DataFrame:
    folder = _folder(llm, "scans")
    st.stream_auto_scan(st.stream_ingest(llm, "llm"), "llm", folder).awaitTermination()
    out = llm.sparkSession.read.parquet(f"{folder}/scans")
    return out.select("tenant_id", "application_id", "risk_score", "findings_count")


@query("W-7", "findings", f"""
WITH l AS (SELECT entity_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY entity_id ORDER BY ts) < INTERVAL 60 MINUTES THEN 0 ELSE 1 END AS nw FROM findings),
s AS (SELECT entity_id, ts, sum(nw) OVER (PARTITION BY entity_id ORDER BY ts) AS k FROM l)
SELECT entity_id, strftime(min(ts), {_SQLFMT}) AS first_seen, strftime(max(ts), {_SQLFMT}) AS last_seen, count(*) AS events FROM s GROUP BY entity_id, k""", stream=True)
def stream_entity_sessions(findings: DataFrame) -> DataFrame:
    out = run_available(st.stream_sessions(findings), "complete")
    return out.withColumns({c: F.date_format(c, _FMT) for c in ("first_seen", "last_seen")})


@query("W-8", "ml", f"""
SELECT application_id, 'f_amount' AS feature_name, {r("arg_max(f_amount, inference_id)")} AS mean_value, max(inference_id) AS version FROM ml GROUP BY application_id""", stream=True)
def stream_active_baselines(ml: DataFrame) -> DataFrame:
    rows = ml.select("application_id", F.lit("f_amount").alias("feature_name"), F.col("f_amount").alias("mean_value"), F.col("inference_id").alias("version"))
    folder = _folder(ml, "baselines")
    st.stream_baselines(rows, folder).awaitTermination()
    return st.current_baselines(ml.sparkSession, folder).withColumn("mean_value", round_to("mean_value", 6))


@query("W-9", "ml", "SELECT inference_id, application_id FROM ml", stream=True)
def stream_dedup(ml: DataFrame) -> DataFrame:
    doubled = ml.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return run_available(st.dedup_ingest(doubled).select("inference_id", "application_id"))


# ---- sinks ---------------------------------------------------------------------------


@query("S-8", "scans", "SELECT tenant_id, count(*) AS rows, sum(scan_id)::BIGINT AS ids FROM scans GROUP BY tenant_id")
def sink_results(scans: DataFrame) -> DataFrame:
    folder = _folder(scans, "results")
    tb.write_results(scans, folder)
    back = scans.sparkSession.read.parquet(folder)
    return back.groupBy(F.col("tenant_id").cast("bigint").alias("tenant_id")).agg(F.count("*").alias("rows"), F.sum("scan_id").alias("ids"))


@query("S-9", "scans", "SELECT strftime(created_at, '%Y-%m') AS month, count(*) AS events FROM scans WHERE created_at >= TIMESTAMP '2024-01-10' AND created_at < TIMESTAMP '2024-02-01' GROUP BY 1")
def sink_audit(scans: DataFrame) -> DataFrame:
    folder = _folder(scans, "audit")
    tb.write_audit(scans, folder)
    back = tb.read_audit(scans.sparkSession, folder, "2024-01-10", "2024-02-01")
    return back.groupBy(F.col("month").cast("string").alias("month")).agg(F.count("*").alias("events"))


@query("S-10", "docs", """
SELECT 'csv' AS fmt, '"' || left(replace(replace(text, '"', '""'), chr(10), '\\n'), 500) || '","' || left(lang, 500) || '"' AS text, NULL AS lang FROM docs
UNION ALL SELECT 'jsonl', text, lang FROM docs""")
def sink_export(docs: DataFrame) -> DataFrame:
    """Both formats written and read back: CSV as its lines, JSON as its fields; labels and ids stay behind."""
    samples = docs.select("doc_id", F.lit(True).alias("is_poisoned"), F.struct("text", "lang").alias("payload"))
    spark, parts = docs.sparkSession, []
    for fmt in ("csv", "jsonl"):
        folder = _folder(docs, f"export-{fmt}")
        tb.export_labelled(samples, folder, fmt)
        back = spark.read.text(folder).toDF("text").withColumn("lang", F.lit(None).cast("string")) if fmt == "csv" else spark.read.schema("text string, lang string").json(folder)
        parts.append(back.select(F.lit(fmt).alias("fmt"), "text", "lang"))
    return parts[0].unionByName(parts[1])
