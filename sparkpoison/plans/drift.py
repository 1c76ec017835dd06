"""Ingestion and inference-telemetry queries with their check SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sparkpoison.functions.numeric import round_to
from sparkpoison.operators import drift as dr, ingest as ing
from sparkpoison.plans.registry import query
from sparkpoison.plans.views import r

_ML = f"""
mln AS (SELECT *, coalesce(confidence_score < 0.3, false) OR coalesce(total_latency_ms > 5000, false) AS is_anomalous,
  least({r("coalesce(greatest(CAST(0.3 AS DOUBLE) - confidence_score, 0.0) / CAST(0.3 AS DOUBLE) * CAST(0.6 AS DOUBLE), 0.0) + coalesce(least(total_latency_ms / 10000.0, 1.0) * CAST(0.4 AS DOUBLE), 0.0)", 4)}, 1.0) AS anomaly_score FROM ml)"""
_RISK = " + ".join(
    (f"coalesce({n}, 0.0)" if n in ("hallucination_risk", "toxicity_score") else f"(1.0 - coalesce({n}, 1.0))")
    + f" * CAST({w} AS DOUBLE)" for n, w in ing.POISONING_WEIGHTS.items())
_LLM = f"""
llr AS (SELECT *, least({r(_RISK, 4)}, 1.0) AS poisoning_risk FROM llm),
lln AS (SELECT *, coalesce(hallucination_risk > 0.7, false) OR coalesce(toxicity_score > 0.6, false) AS is_anomalous,
  nullif(concat_ws(',', CASE WHEN hallucination_risk > 0.7 THEN 'high_hallucination_risk' END, CASE WHEN toxicity_score > 0.6 THEN 'high_toxicity' END,
  CASE WHEN poisoning_risk > 0.5 THEN 'elevated_poisoning_risk' END, CASE WHEN coherence_score < 0.3 THEN 'low_coherence' END,
  CASE WHEN factual_consistency < 0.4 THEN 'low_factual_consistency' END), '') AS flags FROM llr)"""
_EVENTS_END = "2024-01-31 00:00:00"
_ORDERS_END = "2001-08-02 00:00:00"


def _with_map(ml: DataFrame) -> DataFrame:
    pairs = F.create_map(F.lit("f_amount"), F.col("f_amount"), F.lit("f_speed"), F.col("f_speed"))
    return ing.normalise_ml(ml).withColumn("feature_importances", pairs)


@query("S-2", "ml", f"WITH {_ML} SELECT inference_id, tenant_id, is_anomalous, anomaly_score FROM mln")
def ingest_ml(ml: DataFrame) -> DataFrame:
    return ing.normalise_ml(ml).select("inference_id", "tenant_id", "is_anomalous", "anomaly_score")


@query("S-3", "llm", f"WITH {_LLM} SELECT inference_id, tenant_id, is_anomalous, poisoning_risk, flags FROM lln")
def ingest_llm(llm: DataFrame) -> DataFrame:
    out = ing.normalise_llm(llm)
    return out.select("inference_id", "tenant_id", "is_anomalous", "poisoning_risk", F.array_join("flags", ",").alias("flags"))


@query("S-4", "ground_truth", """
SELECT telemetry_id, telemetry_type, predicted_class, actual_class, CAST(NULL AS DOUBLE) AS predicted_score FROM ground_truth""")
def ingest_ground_truth(ground_truth: DataFrame) -> DataFrame:
    out = ing.normalise_ground_truth(ground_truth.withColumn("predicted_score", F.lit("n/a")))
    return out.select("telemetry_id", "telemetry_type", "predicted_class", "actual_class", "predicted_score")


@query("S-4", "events", f"""
SELECT event_type AS application_id, 'value' AS feature_name, {r("avg(value)")} AS mean_value, {r("stddev_pop(value)")} AS std_dev,
  min(value) AS min_value, max(value) AS max_value, 'normal' AS distribution_type, CAST(0.1 AS DOUBLE) AS psi_warning, CAST(0.2 AS DOUBLE) AS psi_critical
FROM events GROUP BY event_type""")
def ingest_baseline(events: DataFrame) -> DataFrame:
    raw = events.groupBy(F.col("event_type").alias("application_id")).agg(
        F.lit("value").alias("feature_name"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    out = ing.normalise_baseline(raw)
    return out.select("application_id", "feature_name", round_to("mean_value", 6).alias("mean_value"),
                      round_to("std_dev", 6).alias("std_dev"), "min_value", "max_value", "distribution_type",
                      "psi_warning", "psi_critical")


@query("S-5", "scans", """
SELECT coalesce(concat_ws(',', CASE WHEN engine NOT IN ('vector_analyzer', 'mcp_auditor') THEN 'engine' END,
  CASE WHEN verdict IS NULL THEN 'verdict' END, CASE WHEN risk_score >= 0.9 THEN 'risk_score' END), '') AS violations, count(*) AS n
FROM scans GROUP BY 1""")
def ingest_quarantine(scans: DataFrame) -> DataFrame:
    rules = {"engine": F.col("engine").isin("vector_analyzer", "mcp_auditor"), "verdict": F.col("verdict").isNotNull(),
             "risk_score": F.col("risk_score") < 0.9}
    ok, bad = ing.quarantine(scans, rules)
    labels = ok.select(F.lit("").alias("violations")).unionByName(bad.select(F.array_join("violations", ",").alias("violations")))
    return labels.groupBy("violations").agg(F.count("*").alias("n"))


@query("S-5", "events", r"""
SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, CAST(NULL AS DOUBLE) AS bad_number, CAST(floor(value + 0.5) AS BIGINT) AS whole FROM events""")
def ingest_coercion(events: DataFrame) -> DataFrame:
    k = F.try_variant_get(ing.to_json("props"), "$.k", "double")
    return events.select("event_id", k.alias("k"), ing.to_float("event_type").alias("bad_number"), ing.to_int("value").alias("whole"))


@query("S-7", "ml", f"""
WITH b AS (SELECT application_id, 'f_amount' AS feature_name, CAST(created_at AS DATE) AS version, avg(f_amount) AS m FROM ml GROUP BY ALL)
SELECT application_id, feature_name, {r("arg_max(m, version)")} AS mean_value, strftime(max(version), '%Y-%m-%d') AS version FROM b GROUP BY ALL""")
def ingest_active_baselines(ml: DataFrame) -> DataFrame:
    daily = ml.groupBy("application_id", F.to_date("created_at").alias("version")).agg(F.avg("f_amount").alias("mean"))
    rows = ing.normalise_baseline(daily.withColumn("feature_name", F.lit("f_amount")))
    out = ing.active_baselines(rows.select("application_id", "feature_name", "mean_value", "version"))
    return out.withColumns({"mean_value": round_to("mean_value", 6), "version": F.date_format("version", "yyyy-MM-dd")})


@query("S-11", "events", f"""
WITH h AS (SELECT event_id // 3 AS scan_id, CASE event_id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'scanning' ELSE 'complete' END AS status, ts AS t FROM events)
SELECT scan_id, arg_max(status, t) AS status, {r("(epoch_us(max(CASE WHEN status = 'complete' THEN t END)) - epoch_us(min(CASE WHEN status = 'scanning' THEN t END))) / 1000.0", 3)} AS duration_ms
FROM h GROUP BY scan_id""")
def ingest_scan_durations(events: DataFrame) -> DataFrame:
    step = F.col("event_id") % 3
    history = events.select(
        F.floor(F.col("event_id") / 3).alias("scan_id"),
        F.when(step == 0, "pending").when(step == 1, "scanning").otherwise("complete").alias("status"), F.col("ts").alias("at"))
    return ing.scan_durations(history).select("scan_id", "status", round_to("duration_ms", 3).alias("duration_ms"))


@query("D-1", "ml llm", f"""
WITH {_ML}, {_LLM},
a AS (SELECT tenant_id, count(*) AS total_ml_inferences, count_if(is_anomalous) AS ml_anomaly_count, {r("avg(total_latency_ms)", 2)} AS avg_ml_latency_ms,
  count_if(drift_detected) AS drift_detected_count FROM mln WHERE created_at >= TIMESTAMP '{_EVENTS_END}' - INTERVAL 240 HOURS GROUP BY tenant_id),
b AS (SELECT tenant_id, count(*) AS total_llm_inferences, count_if(is_anomalous) AS llm_anomaly_count, {r("avg(total_latency_ms)", 2)} AS avg_llm_latency_ms,
  {r("avg(poisoning_risk)", 4)} AS poisoning_risk_avg, {r("avg(hallucination_risk)", 4)} AS hallucination_risk_avg FROM lln
  WHERE created_at >= TIMESTAMP '{_EVENTS_END}' - INTERVAL 240 HOURS GROUP BY tenant_id)
SELECT coalesce(a.tenant_id, b.tenant_id) AS tenant_id, {", ".join(f"coalesce({c}, 0) AS {c}" for c in "total_ml_inferences ml_anomaly_count avg_ml_latency_ms drift_detected_count total_llm_inferences llm_anomaly_count avg_llm_latency_ms poisoning_risk_avg hallucination_risk_avg".split())}
FROM a FULL JOIN b ON a.tenant_id = b.tenant_id""")
def drift_summary(ml: DataFrame, llm: DataFrame) -> DataFrame:
    return dr.telemetry_summary(ing.normalise_ml(ml), ing.normalise_llm(llm), _EVENTS_END, 240)


@query("D-2", "ml baselines", f"""
WITH {_ML},
act AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY application_id, feature_name ORDER BY version DESC) AS rn FROM baselines) WHERE rn = 1),
rec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY application_id ORDER BY created_at DESC, inference_id DESC) AS k FROM mln) WHERE k <= 500),
g AS (SELECT b.application_id, b.feature_name, b.mean_value::DOUBLE AS bm, b.std_dev::DOUBLE AS bs, b.psi_warning::DOUBLE AS pw, b.psi_critical::DOUBLE AS pc,
  avg(coalesce(CASE b.feature_name WHEN 'f_amount' THEN f_amount ELSE f_speed END, anomaly_score)) AS m,
  stddev_samp(coalesce(CASE b.feature_name WHEN 'f_amount' THEN f_amount ELSE f_speed END, anomaly_score)) AS s, count(inference_id) AS n
  FROM act b LEFT JOIN rec USING (application_id) GROUP BY ALL),
p AS (SELECT *, CASE WHEN bs IS NULL OR bs = 0 THEN NULL ELSE abs(m - bm) / bs END AS psi FROM g)
SELECT application_id, feature_name, bm AS baseline_mean, bs AS baseline_std, {r("m")} AS current_mean, {r("s")} AS current_std, n AS sample_count,
  {r("psi", 4)} AS psi_estimate, CASE WHEN bs IS NULL OR bs = 0 THEN 'unknown' WHEN psi >= pc THEN 'critical' WHEN psi >= pw THEN 'warning' ELSE 'ok' END AS status,
  row_number() OVER (PARTITION BY application_id ORDER BY {r("psi", 4)} DESC NULLS FIRST, feature_name) AS position FROM p""")
def drift_features(ml: DataFrame, baselines: DataFrame) -> DataFrame:
    active = ing.active_baselines(baselines)
    active = active.withColumns({c: F.col(c).cast("double") for c in ("mean_value", "std_dev", "psi_warning", "psi_critical")})
    return dr.drift_status(_with_map(ml), active)


@query("D-3", "llm scans", f"""
WITH {_LLM},
sp AS (SELECT tenant_id, CAST(unnest(generate_series(DATE '2001-08-02' - 400, DATE '2001-08-02', INTERVAL 1 DAY)) AS DATE) AS d FROM (SELECT DISTINCT tenant_id FROM llm)),
j AS (SELECT l.*, s.verdict FROM lln l LEFT JOIN scans s ON s.scan_id = l.scan_id AND s.tenant_id = l.tenant_id
  WHERE l.created_at >= TIMESTAMP '{_ORDERS_END}' - INTERVAL 400 DAYS),
g AS (SELECT tenant_id, CAST(created_at AS DATE) AS d, count(*) AS n, {r("avg(poisoning_risk)", 4)} AS a, {r("max(poisoning_risk)", 4)} AS mx,
  count_if(poisoning_risk > 0.5) AS h, count_if(is_anomalous) AS an, count_if(verdict = 'poisoned') AS pv FROM j GROUP BY ALL)
SELECT sp.tenant_id, strftime(sp.d, '%Y-%m-%d') AS date, coalesce(n, 0) AS llm_inferences, coalesce(a, 0) AS avg_poisoning_risk, coalesce(mx, 0) AS max_poisoning_risk,
  coalesce(h, 0) AS high_risk_count, coalesce(an, 0) AS anomaly_count, coalesce(pv, 0) AS poisoned_verdict
FROM sp LEFT JOIN g ON g.tenant_id = sp.tenant_id AND g.d = sp.d""")
def drift_poisoning_timeline(llm: DataFrame, scans: DataFrame) -> DataFrame:
    out = dr.poisoning_timeline(ing.normalise_llm(llm), scans, _ORDERS_END, 400)
    return out.withColumn("date", F.date_format("date", "yyyy-MM-dd"))


_SCAN_COLS = "'telemetry_simulator' AS engine, 'complete' AS status, 'suspicious' AS verdict"


@query("D-4", "ml", f"""
WITH {_ML}, g AS (SELECT tenant_id, application_id, avg(CASE WHEN is_anomalous THEN 1.0 ELSE 0.0 END) AS s, count_if(is_anomalous) AS f FROM mln GROUP BY ALL)
SELECT tenant_id, application_id, {_SCAN_COLS}, {r("s", 4)} AS risk_score, f AS findings_count, 'auto_scan' AS "trigger", 'ml' AS type FROM g WHERE s > 0.1""")
def drift_auto_scan_ml(ml: DataFrame) -> DataFrame:
    return dr.auto_scan(ing.normalise_ml(ml), "ml")


@query("D-5", "llm", f"""
WITH {_LLM}, g AS (SELECT tenant_id, application_id, avg(poisoning_risk) AS s, count_if(poisoning_risk > 0.3) AS f FROM lln GROUP BY ALL)
SELECT tenant_id, application_id, {_SCAN_COLS}, {r("s", 4)} AS risk_score, f AS findings_count, 'auto_scan' AS "trigger", 'llm' AS type FROM g WHERE s > 0.3""")
def drift_auto_scan_llm(llm: DataFrame) -> DataFrame:
    return dr.auto_scan(ing.normalise_llm(llm), "llm")


def _alert_sql(column: str, limit: str, kind: str, label: str) -> str:
    return f"""SELECT tenant_id, inference_id, 'critical' AS severity, '{kind}' AS type, '{label}' AS type_label,
  'LLM inference for application "' || application_id || '" has {column}=' || printf('%.3f', {column}) || ' (threshold: {limit}).' AS message, 'open' AS status
FROM llm WHERE {column} > {limit}"""


@query("D-6", "llm", _alert_sql("hallucination_risk", "0.9", "hallucination_risk_critical", "Critical Hallucination Risk")
       + " UNION ALL " + _alert_sql("toxicity_score", "0.8", "toxicity_critical", "Critical Toxicity Score"))
def drift_row_alerts(llm: DataFrame) -> DataFrame:
    return dr.row_alerts(ing.normalise_llm(llm))


@query("D-7", "ml ground_truth", f"""
WITH j AS (SELECT * FROM ml LEFT JOIN ground_truth ON inference_id = telemetry_id),
g AS (SELECT application_id, count(*) AS n, count(actual_class) AS l, count_if(predicted_class = actual_class) AS c,
  count_if(predicted_class = 'fraudulent' AND actual_class = 'fraudulent') AS tp, count_if(predicted_class = 'fraudulent' AND actual_class <> 'fraudulent') AS fp,
  count_if(predicted_class <> 'fraudulent' AND actual_class = 'fraudulent') AS fn, avg(CASE WHEN actual_class IS NOT NULL THEN confidence_score END) AS cf FROM j GROUP BY ALL)
SELECT application_id, n AS inferences, l AS labelled, c AS correct, {r("c / l")} AS accuracy, {r("tp / (tp + fp)")} AS precision, {r("tp / (tp + fn)")} AS recall,
  {r("cf - c / l")} AS calibration_gap FROM g""")
def drift_ground_truth(ml: DataFrame, ground_truth: DataFrame) -> DataFrame:
    out = dr.ground_truth_report(ml, ground_truth, "fraudulent")
    return out.withColumns({c: round_to(c, 6) for c in ("accuracy", "precision", "recall", "calibration_gap")})


@query("D-8", "llm policies", f"""
WITH {_LLM},
m AS (SELECT tenant_id, application_id, avg(poisoning_risk) AS pr, avg(hallucination_risk) AS hr, avg(CASE WHEN is_anomalous THEN 1.0 ELSE 0.0 END) AS ar FROM lln GROUP BY ALL),
lp AS (SELECT *, max(version) OVER (PARTITION BY tenant_id, application_id, policy_type) AS mv FROM policies WHERE is_active),
ap AS (SELECT * FROM lp WHERE version = mv),
c AS (SELECT m.*, p.policy_type, p.name, p.version, p.metric, p.threshold::DOUBLE AS threshold FROM m JOIN ap p ON p.tenant_id = m.tenant_id AND p.application_id = m.application_id
  UNION ALL SELECT m.*, p.policy_type, p.name, p.version, p.metric, p.threshold::DOUBLE FROM m JOIN ap p ON p.tenant_id = m.tenant_id AND p.application_id IS NULL
  WHERE NOT EXISTS (SELECT 1 FROM ap q WHERE q.tenant_id = m.tenant_id AND q.application_id = m.application_id AND q.policy_type = p.policy_type)),
v AS (SELECT *, CASE metric WHEN 'poisoning_risk' THEN pr WHEN 'hallucination_risk' THEN hr ELSE ar END AS value FROM c)
SELECT tenant_id, application_id, policy_type, name AS policy, version, metric, threshold, {r("value")} AS value, value >= threshold AS breached FROM v""")
def drift_policies(llm: DataFrame, policies: DataFrame) -> DataFrame:
    rows = ing.normalise_llm(llm).groupBy("tenant_id", "application_id").agg(
        F.avg("poisoning_risk").alias("p"), F.avg("hallucination_risk").alias("h"), F.avg(F.col("is_anomalous").cast("double")).alias("a"))
    metrics = rows.select("tenant_id", "application_id", F.create_map(
        F.lit("poisoning_risk"), F.col("p"), F.lit("hallucination_risk"), F.col("h"), F.lit("anomaly_rate"), F.col("a")).alias("metrics"))
    entry = F.struct("metric", F.col("threshold").cast("double").alias("threshold"))
    stored = policies.groupBy("tenant_id", "application_id", "policy_type", "name", "version", "is_active").agg(
        F.map_from_entries(F.collect_list(entry)).alias("thresholds"))
    out = dr.evaluate_policies(metrics, stored)
    return out.withColumn("value", round_to("value", 6))


@query("D-9", "ml llm", f"""
WITH {_ML}, {_LLM}
SELECT 'anomalous' AS queue, tenant_id, inference_id, anomaly_score AS score FROM mln WHERE is_anomalous
UNION ALL SELECT 'poisoning', tenant_id, inference_id, poisoning_risk FROM lln WHERE poisoning_risk > 0.3
UNION ALL SELECT 'hallucination', tenant_id, inference_id, hallucination_risk FROM lln WHERE hallucination_risk > 0.5""")
def drift_triage(ml: DataFrame, llm: DataFrame) -> DataFrame:
    return dr.triage(ing.normalise_ml(ml), ing.normalise_llm(llm))


@query("D-10", "ml", f"""
WITH b AS (SELECT application_id, f_amount AS v FROM ml WHERE created_at < TIMESTAMP '2024-01-16'),
c AS (SELECT application_id, f_amount AS v FROM ml WHERE created_at >= TIMESTAMP '2024-01-16'),
sp AS (SELECT application_id, min(v) AS lo, max(v) AS hi FROM b GROUP BY ALL),
hb AS (SELECT application_id, greatest(least(floor((v - lo) / greatest((hi - lo) / 10, 1e-12)), 9), 0) AS bin, count(*) AS n FROM b JOIN sp USING (application_id) GROUP BY ALL),
hc AS (SELECT application_id, greatest(least(floor((v - lo) / greatest((hi - lo) / 10, 1e-12)), 9), 0) AS bin, count(*) AS n FROM c JOIN sp USING (application_id) GROUP BY ALL),
pb AS (SELECT application_id, bin, n / sum(n) OVER (PARTITION BY application_id) AS p FROM hb),
pc AS (SELECT application_id, bin, n / sum(n) OVER (PARTITION BY application_id) AS p FROM hc),
j AS (SELECT coalesce(pb.application_id, pc.application_id) AS application_id, greatest(coalesce(pb.p, 0), 1e-4) AS b, greatest(coalesce(pc.p, 0), 1e-4) AS c
  FROM pb FULL JOIN pc ON pb.application_id = pc.application_id AND pb.bin = pc.bin)
SELECT application_id, {r("sum((c - b) * ln(c / b))")} AS psi FROM j GROUP BY application_id""")
def drift_psi(ml: DataFrame) -> DataFrame:
    middle = F.lit("2024-01-16").cast("timestamp")
    old, new = ml.where(F.col("created_at") < middle), ml.where(F.col("created_at") >= middle)
    return dr.psi(old, new, "f_amount").withColumn("psi", round_to("psi", 6))
