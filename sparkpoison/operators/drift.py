"""Roll-ups of inference telemetry: summaries, drift, ground truth, policies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkpoison.functions.numeric import round_to, share


def instant(value: str | Column) -> Column:
    return F.lit(value).cast("timestamp") if isinstance(value, str) else value


def ago(as_of: str | Column, amount: int, unit: str) -> Column:
    return instant(as_of) - F.expr(f"INTERVAL {int(amount)} {unit}")


def telemetry_summary(ml: DataFrame, llm: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """Per tenant counts, anomalies, latencies and risks of both telemetry tables in the window."""
    since = ago(as_of, hours, "HOURS")
    a = ml.where(F.col("created_at") >= since).groupBy("tenant_id").agg(
        F.count("*").alias("total_ml_inferences"), F.count_if("is_anomalous").alias("ml_anomaly_count"),
        round_to(F.avg("total_latency_ms"), 2).alias("avg_ml_latency_ms"),
        F.count_if("drift_detected").alias("drift_detected_count"),
    )
    b = llm.where(F.col("created_at") >= since).groupBy("tenant_id").agg(
        F.count("*").alias("total_llm_inferences"), F.count_if("is_anomalous").alias("llm_anomaly_count"),
        round_to(F.avg("total_latency_ms"), 2).alias("avg_llm_latency_ms"),
        round_to(F.avg("poisoning_risk"), 4).alias("poisoning_risk_avg"),
        round_to(F.avg("hallucination_risk"), 4).alias("hallucination_risk_avg"),
    )
    return a.join(b, "tenant_id", "full_outer").na.fill(0)


def drift_status(
    ml: DataFrame, baselines: DataFrame, last_n: int = 500, importances: str = "feature_importances"
) -> DataFrame:
    """Mean shift of each baselined feature over the last rows of its application.

    The last ``last_n`` rows are ranked once per application (pruned per task before the
    shuffle), not once per baseline.
    """
    w = Window.partitionBy("application_id").orderBy(F.col("created_at").desc(), F.col("inference_id").desc())
    recent = (
        ml.select("application_id", "inference_id", "created_at", importances, "anomaly_score")
        .withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= last_n)
    )
    value = F.coalesce(F.element_at(importances, F.col("feature_name")), F.col("anomaly_score"))
    keys = ["application_id", "feature_name", "mean_value", "std_dev", "psi_warning", "psi_critical"]
    grouped = (
        baselines.select(*keys).join(recent, "application_id", "left").withColumn("_v", value)
        .groupBy(*keys)
        .agg(F.avg("_v").alias("_mean"), F.stddev_samp("_v").alias("_std"), F.count("inference_id").alias("sample_count"))
    )
    usable = F.col("std_dev").isNotNull() & (F.col("std_dev") != 0)
    psi = F.abs(F.col("_mean") - F.col("mean_value")) / F.when(usable, F.col("std_dev"))
    order = Window.partitionBy("application_id").orderBy(F.col("psi_estimate").desc_nulls_first(), "feature_name")
    return grouped.select(
        "application_id", "feature_name", F.col("mean_value").alias("baseline_mean"), F.col("std_dev").alias("baseline_std"),
        round_to("_mean", 6).alias("current_mean"), round_to("_std", 6).alias("current_std"), "sample_count",
        round_to(psi, 4).alias("psi_estimate"),
        F.when(~usable, "unknown").when(psi >= F.col("psi_critical"), "critical")
        .when(psi >= F.col("psi_warning"), "warning").otherwise("ok").alias("status"),
    ).withColumn("position", F.row_number().over(order))


def day_spine(keys: DataFrame, as_of: str, days: int) -> DataFrame:
    """Every key with each of the days+1 calendar days up to ``as_of``."""
    first, last = ago(as_of, days, "DAYS").cast("date"), instant(as_of).cast("date")
    return keys.distinct().withColumn("date", F.explode(F.sequence(first, last)))


def poisoning_timeline(llm: DataFrame, scans: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Per tenant and day: generation counts, risk statistics, and links to poisoned scans; empty days are 0."""
    verdicts = scans.select("scan_id", "tenant_id", "verdict")
    recent = llm.where(F.col("created_at") >= ago(as_of, days, "DAYS"))
    daily = (
        recent.join(verdicts, ["scan_id", "tenant_id"], "left")
        .groupBy("tenant_id", F.to_date("created_at").alias("date"))
        .agg(
            F.count("*").alias("llm_inferences"), round_to(F.avg("poisoning_risk"), 4).alias("avg_poisoning_risk"),
            round_to(F.max("poisoning_risk"), 4).alias("max_poisoning_risk"),
            F.count_if(F.col("poisoning_risk") > 0.5).alias("high_risk_count"),
            F.count_if("is_anomalous").alias("anomaly_count"),
            F.count_if(F.col("verdict") == "poisoned").alias("poisoned_verdict"),
        )
    )
    return day_spine(llm.select("tenant_id"), as_of, days).join(daily, ["tenant_id", "date"], "left").na.fill(0)


def auto_scan(rows: DataFrame, kind: str, by: Sequence[str] = ("tenant_id", "application_id")) -> DataFrame:
    """Suspicious scans raised by an ingested batch.

    ``kind="ml"``: more than 10 % anomalous rows. ``kind="llm"``: mean poisoning risk over 0.3.
    """
    if kind == "ml":
        score, found, limit = F.avg(F.col("is_anomalous").cast("double")), F.count_if("is_anomalous"), 0.1
    else:
        score, found, limit = F.avg("poisoning_risk"), F.count_if(F.col("poisoning_risk") > 0.3), 0.3
    return (
        rows.groupBy(*by).agg(score.alias("_score"), found.alias("findings_count"))
        .where(F.col("_score") > limit)
        .select(
            *by, F.lit("telemetry_simulator").alias("engine"), F.lit("complete").alias("status"),
            F.lit("suspicious").alias("verdict"), round_to("_score", 4).alias("risk_score"), "findings_count",
            F.lit("auto_scan").alias("trigger"), F.lit(kind).alias("type"),
        )
    )


def row_alerts(llm: DataFrame) -> DataFrame:
    """One critical alert per generation whose hallucination risk exceeds 0.9 or toxicity 0.8."""

    def alert(column: str, limit: float, kind: str, label: str) -> Column:
        message = F.concat(
            F.lit('LLM inference for application "'), F.col("application_id"), F.lit(f'" has {column}='),
            F.format_string("%.3f", F.col(column)), F.lit(f" (threshold: {limit})."),
        )
        return F.when(
            F.col(column) > limit,
            F.struct(F.lit("critical").alias("severity"), F.lit(kind).alias("type"), F.lit(label).alias("type_label"),
                     message.alias("message"), F.lit("open").alias("status")),
        )

    alerts = F.array_compact(
        F.array(
            alert("hallucination_risk", 0.9, "hallucination_risk_critical", "Critical Hallucination Risk"),
            alert("toxicity_score", 0.8, "toxicity_critical", "Critical Toxicity Score"),
        )
    )
    return llm.select("tenant_id", "inference_id", F.explode(alerts).alias("a")).select("tenant_id", "inference_id", "a.*")


def ground_truth_report(telemetry: DataFrame, truth: DataFrame, positive: str, by: Sequence[str] = ("application_id",)) -> DataFrame:
    """Correctness, precision and recall of predictions against what was later observed.

    ``calibration_gap`` is the mean confidence minus the share of correct predictions.
    """
    joined = telemetry.join(truth, telemetry["inference_id"] == truth["telemetry_id"], "left")
    known = F.col("actual_class").isNotNull()
    said, was = F.col("predicted_class") == positive, F.col("actual_class") == positive
    right = known & (F.col("predicted_class") == F.col("actual_class"))
    out = joined.groupBy(*by).agg(
        F.count("*").alias("inferences"), F.count_if(known).alias("labelled"), F.count_if(right).alias("correct"),
        F.count_if(said & was).alias("tp"), F.count_if(said & known & ~was).alias("fp"), F.count_if(was & ~said).alias("fn"),
        F.avg(F.when(known, F.col("confidence_score"))).alias("_conf"),
    )
    accuracy = share(F.col("correct"), F.col("labelled"))
    return out.select(
        *by, "inferences", "labelled", "correct", accuracy.alias("accuracy"),
        share(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        share(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
        (F.col("_conf") - accuracy).alias("calibration_gap"),
    )


def evaluate_policies(metrics: DataFrame, policies: DataFrame) -> DataFrame:
    """Compare each application's metrics with its active policies: of each type its own, else its tenant's default.

    ``metrics(tenant_id, application_id, metrics MAP)``; ``policies(tenant_id, application_id,
    policy_type, name, version, is_active, thresholds MAP)``, application null for a default.
    """
    latest = (
        policies.where("is_active").groupBy("tenant_id", "application_id", "policy_type")
        .agg(F.max_by(F.struct("name", "version", "thresholds"), "version").alias("policy"))
    )
    apps = metrics.select("tenant_id", "application_id").distinct()
    own = latest.where(F.col("application_id").isNotNull()).join(apps, ["tenant_id", "application_id"], "left_semi")
    default = latest.where(F.col("application_id").isNull()).drop("application_id").join(apps, "tenant_id")
    inherited = default.join(own, ["tenant_id", "application_id", "policy_type"], "left_anti")
    chosen = metrics.join(own.unionByName(inherited), ["tenant_id", "application_id"])
    checks = chosen.select(
        "tenant_id", "application_id", "policy_type", F.col("policy.name").alias("policy"), F.col("policy.version").alias("version"),
        F.explode("policy.thresholds").alias("metric", "threshold"), "metrics",
    )
    value = F.element_at("metrics", F.col("metric"))
    return checks.select(
        "tenant_id", "application_id", "policy_type", "policy", "version", "metric", "threshold", value.alias("value"),
        F.coalesce(value >= F.col("threshold"), F.lit(False)).alias("breached"),
    )


def triage(ml: DataFrame, llm: DataFrame) -> DataFrame:
    """The review queues: anomalous inferences, poisoning over 0.3, hallucination over 0.5."""
    def queue(df: DataFrame, name: str, test: Column, score: str) -> DataFrame:
        return df.where(test).select(F.lit(name).alias("queue"), "tenant_id", "inference_id", F.col(score).alias("score"))

    return (
        queue(ml, "anomalous", F.col("is_anomalous"), "anomaly_score")
        .unionByName(queue(llm, "poisoning", F.col("poisoning_risk") > 0.3, "poisoning_risk"))
        .unionByName(queue(llm, "hallucination", F.col("hallucination_risk") > 0.5, "hallucination_risk"))
    )


def psi(base: DataFrame, current: DataFrame, value: str, by: Sequence[str] = ("application_id",), bins: int = 10, floor: float = 1e-4) -> DataFrame:
    """Population stability index over equal-width bins of the baseline's range (ends are open)."""
    by = list(by)
    span = base.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))

    def shares(df: DataFrame, name: str) -> DataFrame:
        width = F.greatest((F.col("_hi") - F.col("_lo")) / bins, F.lit(1e-12))
        at = F.greatest(F.least(F.floor((F.col(value) - F.col("_lo")) / width), F.lit(bins - 1)), F.lit(0))
        counts = df.where(F.col(value).isNotNull()).join(span, by).groupBy(*by, at.alias("bin")).agg(F.count("*").alias("_c"))
        total = F.sum("_c").over(Window.partitionBy(*by))
        return counts.select(*by, "bin", (F.col("_c") / total).alias(name))

    both = shares(base, "b").join(shares(current, "c"), [*by, "bin"], "full_outer")
    b, c = (F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(floor)) for x in ("b", "c"))
    return both.groupBy(*by).agg(F.sum((c - b) * F.log(c / b)).alias("psi"))
