"""Normalising raw telemetry, validating it and keeping reference rows current."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkpoison.functions import catalogue as cat
from sparkpoison.functions.numeric import cap1, round_to


# --------------------------------------------------------------------------- coercion

def to_float(value: Column | str) -> Column:
    """A finite double, or null for anything else."""
    number = F.expr(f"try_cast(`{value}` AS DOUBLE)") if isinstance(value, str) else value.try_cast("double")
    finite = ~F.isnan(number) & (F.abs(number) != float("inf"))
    return F.when(finite, number)


def to_int(value: Column | str) -> Column:
    """The number rounded half up."""
    return F.floor(to_float(value) + 0.5).cast("bigint")


def to_json(value: Column | str) -> Column:
    """Parsed JSON, or null when it does not parse."""
    return F.try_parse_json(value)


def to_float_array(values: Column | str) -> Column:
    """All elements as doubles, or null if any is not one."""
    col = F.col(values) if isinstance(values, str) else values
    numbers = F.transform(col, to_float)
    return F.when(F.forall(numbers, lambda x: x.isNotNull()), numbers)


def _present(df: DataFrame, name: str, dtype: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype)


# --------------------------------------------------------------------------- normalisation

_ML_TEXT = ["application_id", "model_name", "model_version", "prediction_class", "decision"]
_ML_NUMBERS = [
    "confidence_score", "decision_threshold", "cpu_utilization_pct", "gpu_utilization_pct", "memory_used_mb",
    "total_latency_ms", "queue_wait_ms", "model_inference_ms",
]


def normalise_ml(raw: DataFrame) -> DataFrame:
    """Raw inference records → typed rows with is_anomalous and anomaly_score. Other columns pass through."""
    numbers = {n: to_float(n) for n in _ML_NUMBERS if n in raw.columns}
    renamed = {"prediction_raw": "prediction_score", "telemetry_id": "inference_id"}
    df = raw.withColumns(numbers)
    for old, new in renamed.items():
        if old in raw.columns:
            df = df.withColumn(new, to_float(old) if old == "prediction_raw" else F.col(old)).drop(old)
    for name in ("raw_input_payload", "feature_importances"):
        if dict(raw.dtypes).get(name) == "string":
            df = df.withColumn(name, to_json(name))
    if dict(raw.dtypes).get("feature_vector", "").startswith("array"):
        df = df.withColumn("feature_vector", to_float_array("feature_vector"))
    conf, lat = F.col("confidence_score"), F.col("total_latency_ms")
    low = F.coalesce(F.greatest(0.3 - conf, F.lit(0.0)) / 0.3 * 0.6, F.lit(0.0))
    slow = F.coalesce(cap1(lat / 10000.0) * 0.4, F.lit(0.0))
    return df.withColumns(
        {
            "is_anomalous": F.coalesce(conf < 0.3, F.lit(False)) | F.coalesce(lat > 5000, F.lit(False)),
            "anomaly_score": cap1(round_to(low + slow, 4)),
        }
    )


#: fixed values: weights of the poisoning risk
POISONING_WEIGHTS = {
    "hallucination_risk": 0.35, "toxicity_score": 0.25, "coherence_score": 0.15,
    "relevance_score": 0.10, "factual_consistency": 0.10, "completeness_score": 0.05,
}
_LLM_NUMBERS = [
    *POISONING_WEIGHTS, "fluency_score", "tokens_per_second", "estimated_cost_usd", "gpu_utilization_pct",
    "gpu_memory_used_gb", "total_latency_ms", "time_to_first_token_ms", "semantic_similarity",
    "semantic_similarity_score",
]


def normalise_llm(raw: DataFrame) -> DataFrame:
    """Raw generation records → typed rows with is_anomalous, poisoning_risk and flags."""
    df = raw.withColumns({n: to_float(n) for n in _LLM_NUMBERS if n in raw.columns})
    df = df.withColumns({n: to_int(n) for n in ("input_tokens", "output_tokens", "context_tokens") if n in raw.columns})
    if "semantic_similarity_score" in raw.columns:
        df = df.withColumn(
            "semantic_similarity", F.coalesce("semantic_similarity_score", _present(df, "semantic_similarity", "double"))
        ).drop("semantic_similarity_score")
    for name in ("input_embedding", "output_embedding"):
        if name in raw.columns:
            df = df.withColumn(name, to_float_array(name))
    hall, tox = F.col("hallucination_risk"), F.col("toxicity_score")
    risk = F.lit(0.0)
    for name, weight in POISONING_WEIGHTS.items():
        harmful = name in ("hallucination_risk", "toxicity_score")
        part = F.coalesce(name, F.lit(0.0)) if harmful else 1.0 - F.coalesce(name, F.lit(1.0))
        risk = risk + part * weight
    df = df.withColumn("poisoning_risk", cap1(round_to(risk, 4)))
    flags = F.array_compact(
        F.array(
            F.when(hall > 0.7, "high_hallucination_risk"),
            F.when(tox > 0.6, "high_toxicity"),
            F.when(F.col("poisoning_risk") > 0.5, "elevated_poisoning_risk"),
            F.when(F.col("coherence_score") < 0.3, "low_coherence"),
            F.when(F.col("factual_consistency") < 0.4, "low_factual_consistency"),
        )
    )
    return df.withColumns(
        {
            "is_anomalous": F.coalesce(hall > 0.7, F.lit(False)) | F.coalesce(tox > 0.6, F.lit(False)),
            "flags": F.when(F.size(flags) > 0, flags),
        }
    )


def normalise_ground_truth(raw: DataFrame) -> DataFrame:
    text = ["inference_id", "predicted_class", "actual_class", "outcome_timestamp", "label_source"]
    return raw.select(
        *[F.col(c) for c in ("tenant_id",) if c in raw.columns],
        _present(raw, "telemetry_id").alias("telemetry_id"),
        F.coalesce(_present(raw, "telemetry_type"), F.lit("ml")).alias("telemetry_type"),
        *[_present(raw, c).alias(c) for c in text],
        *[to_float(_present(raw, c)).alias(c) for c in ("predicted_score", "actual_value", "label_confidence")],
        _present(raw, "prediction_correct", "boolean").cast("boolean").alias("prediction_correct"),
        to_json(_present(raw, "metadata")).alias("metadata"),
    )


def normalise_baseline(raw: DataFrame, application_id: str | None = None) -> DataFrame:
    """Per-feature reference statistics with their default thresholds."""
    stats = {"mean": "mean_value", "std": "std_dev", "min": "min_value", "max": "max_value"}
    return raw.select(
        *[F.col(c) for c in ("tenant_id", "version") if c in raw.columns],
        F.coalesce(_present(raw, "application_id"), F.lit(application_id)).alias("application_id"),
        F.col("feature_name"),
        *[to_float(_present(raw, old)).alias(new) for old, new in stats.items()],
        *[to_float(_present(raw, p)).alias(p) for p in ("p25", "p50", "p75", "p95", "p99")],
        F.coalesce(_present(raw, "distribution_type"), F.lit("normal")).alias("distribution_type"),
        to_json(_present(raw, "distribution_params")).alias("distribution_params"),
        F.coalesce(to_float(_present(raw, "psi_warning")), F.lit(0.1)).alias("psi_warning"),
        F.coalesce(to_float(_present(raw, "psi_critical")), F.lit(0.2)).alias("psi_critical"),
        F.lit(True).alias("is_active"),
    )


# --------------------------------------------------------------------------- validation



def scan_rules() -> dict[str, Column]:
    """The value checks of the scans table; null means the check does not apply."""
    return {
        "engine": F.col("engine").isin(list(cat.ENGINE_LABELS)),
        "verdict": F.col("verdict").isNull() | F.col("verdict").isin(cat.SCAN_VERDICTS),
        "risk_score": F.col("risk_score").isNull() | F.col("risk_score").between(0, 1),
    }


def with_violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    failed = [F.when(~F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules.items()]
    return df.withColumn("violations", F.array_compact(F.array(*failed)))


def quarantine(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows passing every rule, the rest with the rules they break)."""
    checked = with_violations(df, rules)
    return checked.where(F.size("violations") == 0).drop("violations"), checked.where(F.size("violations") > 0)


# --------------------------------------------------------------------------- upserts and lifecycle

def active_baselines(df: DataFrame, keys: Sequence[str] = ("application_id", "feature_name")) -> DataFrame:
    """The latest version per key: an aggregate, so old versions are dropped before the shuffle."""
    others = [c for c in df.columns if c not in keys]
    latest = F.max_by(F.struct(*others), "version")
    return df.groupBy(*keys).agg(latest.alias("_r")).select(*keys, "_r.*").select(*df.columns)


def upsert_baselines(stored: DataFrame, incoming: DataFrame, keys: Sequence[str] = ("application_id", "feature_name")) -> DataFrame:
    """Incoming rows become active; stored rows of the same key are kept but no longer active."""
    touched = incoming.select(*keys).distinct().withColumn("_new", F.lit(True))
    kept = stored.join(touched, list(keys), "left").withColumn(
        "is_active", F.col("is_active") & F.col("_new").isNull()
    )
    return kept.select(*stored.columns).unionByName(incoming.withColumn("is_active", F.lit(True)), allowMissingColumns=True)


def scan_durations(history: DataFrame) -> DataFrame:
    """Start, completion and duration of each scan from its status changes ``(scan_id, status, at)``."""
    w = Window.partitionBy("scan_id").orderBy("at", "status")
    before = F.lag("status").over(w)
    changes = history.withColumn("_done", (F.col("status") == "complete") & ~before.eqNullSafe(F.lit("complete")))
    out = changes.groupBy("scan_id").agg(
        F.min(F.when(F.col("status") == "scanning", F.col("at"))).alias("started_at"),
        F.max(F.when(F.col("_done"), F.col("at"))).alias("completed_at"),
        F.max_by("status", F.struct("at", "status")).alias("status"),
    )
    return out.withColumn(
        "duration_ms", (F.unix_micros("completed_at") - F.unix_micros("started_at")) / 1000.0
    )
