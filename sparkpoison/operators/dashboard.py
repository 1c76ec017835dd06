"""Dashboards, listings and alert roll-ups. Each summary is one pass of conditional aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkpoison.functions import catalogue as cat
from sparkpoison.functions.numeric import banded, round_to, share
from sparkpoison.operators.drift import ago, day_spine, instant


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def is_threat() -> Column:
    """A verdict other than clean; a missing one is no threat."""
    return F.coalesce(F.col("verdict") != "clean", F.lit(False))


# --------------------------------------------------------------------------- summaries

def summary(scans: DataFrame, as_of: str) -> DataFrame:
    """Per tenant the 30-day totals with their change, active engines, hourly threats, clean rate."""
    at, threat = F.col("created_at"), is_threat()
    d30, d60 = ago(as_of, 30, "DAYS"), ago(as_of, 60, "DAYS")
    h24, h48 = ago(as_of, 24, "HOURS"), ago(as_of, 48, "HOURS")
    now, before = at >= d30, (at >= d60) & (at < d30)
    day, day_before = at >= h24, (at >= h48) & (at < h24)
    distinct = lambda test: F.count_distinct(F.when(test, F.col("engine")))
    sums = scans.groupBy("tenant_id").agg(
        F.count_if(now).alias("a"), F.count_if(before).alias("b"), F.count_if(now & threat).alias("c"),
        F.count_if(before & threat).alias("d"), distinct(day).alias("e"), distinct(day_before).alias("f"),
        F.count_if(day & threat).alias("g"), F.count_if(day_before & threat).alias("h"),
        F.count_if(now & (F.col("verdict") == "clean")).alias("i"), F.count_if(now & F.col("verdict").isNotNull()).alias("j"),
    )
    return sums.select(
        "tenant_id", F.col("a").alias("total_scans"), (F.col("a") - F.col("b")).alias("total_scans_change"),
        F.col("c").alias("threats_detected"), (F.col("c") - F.col("d")).alias("threats_change"),
        F.col("e").alias("active_monitors"), (F.col("e") - F.col("f")).alias("monitors_change"),
        round_to(F.col("g") / 24.0, 2).alias("threat_velocity"),
        round_to(F.col("g") / 24.0 - F.col("h") / 24.0, 2).alias("velocity_change"),
        round_to(share(F.col("i"), F.col("j")) * 100, 1).alias("clean_rate"),
    )


def daily_timeline(scans: DataFrame, as_of: str, days: int = 14) -> DataFrame:
    """Scans and threats per tenant and day, days without any included."""
    daily = scans.where(F.col("created_at") >= ago(as_of, days, "DAYS")).groupBy(
        "tenant_id", F.to_date("created_at").alias("date")
    ).agg(F.count("*").alias("scans"), F.count_if(is_threat()).alias("threats"))
    return day_spine(scans.select("tenant_id"), as_of, days).join(daily, ["tenant_id", "date"], "left").na.fill(0)


def threat_breakdown(scans: DataFrame, as_of: str) -> DataFrame:
    """Threats per tenant and engine over 30 days with label, colour and percentage."""
    counts = scans.where(is_threat() & (F.col("created_at") >= ago(as_of, 30, "DAYS"))).groupBy("tenant_id", "engine").agg(
        F.count("*").alias("count")
    )
    total = F.sum("count").over(Window.partitionBy("tenant_id"))
    return counts.select(
        "tenant_id", F.col("engine").alias("type"), _map(cat.ENGINE_LABELS)[F.col("engine")].alias("label"), "count",
        round_to(F.col("count") / total * 100, 1).alias("percentage"), _map(cat.ENGINE_COLOURS)[F.col("engine")].alias("color"),
    )


def metrics_router(vector: DataFrame, mcp: DataFrame, rag: DataFrame, provenance: DataFrame, as_of: str) -> DataFrame:
    """All-time totals, the day's threats per category and the hour's scans, per tenant.

    Each input is ``(tenant_id, at, is_threat)``; provenance only adds its own category.
    """
    parts = [("vector", vector), ("mcp", mcp), ("rag", rag), ("provenance", provenance)]
    rows = None
    for name, df in parts:
        one = df.select("tenant_id", "at", F.coalesce("is_threat", F.lit(False)).alias("is_threat"), F.lit(name).alias("kind"))
        rows = one if rows is None else rows.unionByName(one)
    scan = F.col("kind") != "provenance"
    day = F.col("is_threat") & (F.col("at") >= ago(as_of, 24, "HOURS"))
    out = rows.groupBy("tenant_id").agg(
        F.count_if(scan).alias("total_scans"), F.count_if(scan & F.col("is_threat")).alias("threats_detected"),
        F.count_if(scan & (F.col("at") >= ago(as_of, 1, "HOURS"))).cast("double").alias("scan_velocity"),
        F.count_if(day & (F.col("kind") == "vector")).alias("vector_poisoning"),
        F.count_if(day & (F.col("kind") == "mcp")).alias("mcp_injections"),
        F.count_if(day & (F.col("kind") == "rag")).alias("rag_contamination"),
        F.count_if(day & (F.col("kind") == "provenance")).alias("provenance_anomalies"),
        F.max(F.when(scan, F.col("at"))).alias("last_scan_at"),
    )
    clean = (F.col("total_scans") - F.col("threats_detected")) / F.col("total_scans")
    return out.withColumn("clean_rate", F.when(F.col("total_scans") > 0, clean).otherwise(1.0))


def bucketed(scans: DataFrame, granularity: str, as_of: str, hours: int = 24) -> DataFrame:
    """Threat counts per tenant and minute, hour or day."""
    if granularity not in ("minute", "hour", "day"):
        raise ValueError(f"granularity must be minute, hour or day, not {granularity!r}")
    return (
        scans.where(is_threat() & (F.col("created_at") >= ago(as_of, hours, "HOURS")))
        .groupBy("tenant_id", F.date_trunc(granularity, "created_at").alias("bucket")).agg(F.count("*").alias("threats"))
    )


def histogram10(df: DataFrame, value: str, by: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """Counts of [0, 1] in equal bins; values from 1 up fall in the last, negative ones nowhere."""
    by = list(by)
    at = F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).cast("int")
    seen = df.where(F.col(value) >= 0).groupBy(*by, at.alias("bin")).agg(F.count("*").alias("count"))
    if by:
        grid = df.select(*by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    else:
        grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = grid.join(seen, [*by, "bin"], "left").na.fill(0, ["count"])
    return out.select(*by, (F.col("bin") / bins).alias("range_start"), ((F.col("bin") + 1) / bins).alias("range_end"), "count")


def combined(scans: DataFrame, alerts: DataFrame, as_of: str, days: int = 14, limit: int = 8) -> dict[str, DataFrame]:
    """The four parts of the dashboard; each fails or succeeds on its own."""
    return {
        "summary": summary(scans, as_of), "timeline": daily_timeline(scans, as_of, days),
        "threat_breakdown": threat_breakdown(scans, as_of), "recent_alerts": recent_alerts(alerts, limit),
    }


def connector_rollup(connectors: DataFrame) -> DataFrame:
    return connectors.groupBy("type").agg(
        F.count("*").alias("total"), F.count_if(F.col("status").isin("connected", "scanning")).alias("connected"),
        F.count_if(F.col("verdict").isin("malicious", "suspicious")).alias("active_threats"),
        F.sum(F.coalesce("findings", F.lit(0))).alias("findings"),
    )


# --------------------------------------------------------------------------- alerts

def alert_columns(df: DataFrame) -> DataFrame:
    """Turn scans with a new bad verdict into alerts."""
    label = F.initcap(F.replace("engine", F.lit("_"), F.lit(" ")))
    score = F.coalesce(F.format_string("%.4f", "risk_score"), F.lit("N/A"))
    return df.select(
        "tenant_id", "scan_id", F.when(F.col("verdict") == "poisoned", "critical").otherwise("high").alias("severity"),
        F.col("engine").alias("type"), label.alias("type_label"),
        F.concat(label, F.lit(" scan returned verdict: "), "verdict", F.lit(" (risk score: "), score, F.lit(")")).alias("message"),
        F.lit("open").alias("status"),
    )


def auto_alerts(history: DataFrame, order: str = "created_at") -> DataFrame:
    """An alert each time a scan's verdict becomes suspicious or poisoned; ``history`` has one row per change."""
    before = F.lag("verdict").over(Window.partitionBy("scan_id").orderBy(order))
    changed = history.withColumn("_before", before).where(
        F.col("verdict").isin("suspicious", "poisoned") & ~F.col("verdict").eqNullSafe(F.col("_before"))
    )
    return alert_columns(changed)


def recent_alerts(alerts: DataFrame, limit: int | None = 8, severity: str | None = None, status: str | None = None) -> DataFrame:
    """The most severe, then newest alerts, optionally of one severity or status; ties go by ``alert_id``."""
    if severity:
        alerts = alerts.where(F.col("severity") == severity)
    if status:
        alerts = alerts.where(F.col("status") == status)
    rank = F.coalesce(F.create_map(*[F.lit(x) for p in cat.SEVERITY_RANK.items() for x in p])[F.col("severity")], F.lit(9))
    ranked = alerts.orderBy(rank, F.col("created_at").desc(), "alert_id")
    return ranked if limit is None else ranked.limit(limit)


def alert_counts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("tenant_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("severity") == "critical").alias("critical"),
        F.count_if(F.col("status") == "open").alias("open"), F.count_if(F.col("status") == "resolved").alias("resolved"),
    )


# --------------------------------------------------------------------------- listings

def page(df: DataFrame, order: Sequence[Column], number: int = 1, size: int = 20) -> DataFrame:
    """One page of a listing with the total rows and pages on every row."""
    total = df.agg(F.count("*")).scalar()
    rows = df.orderBy(*order).offset((number - 1) * size).limit(size)
    return rows.withColumn("total", total).withColumn(
        "total_pages", F.greatest(F.ceil(F.col("total") / size), F.lit(1)).cast("bigint")
    )


def top_per_engine(scans: DataFrame, as_of: str, hours: int = 24, limit: int = 50) -> DataFrame:
    """Each engine's highest scores in the window, per tenant (pruned per task before the shuffle)."""
    w = Window.partitionBy("tenant_id", "engine").orderBy(F.col("risk_score").desc(), "scan_id")
    recent = scans.where(F.col("created_at") >= ago(as_of, hours, "HOURS"))
    return recent.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def pattern_catalogue(spark, category: str | None = None, severity: str | None = None) -> DataFrame:
    """The known patterns, optionally of one category or severity."""
    rows = [(n, k, s, p) for n, k, s, p, _ in cat.INJECTION_PATTERNS] + [
        (n, "corpus_heuristic", s, " | ".join(p for p, _ in o)) for n, s, o, _ in cat.HEURISTICS
    ]
    df = spark.createDataFrame(rows, "pattern string, category string, severity string, regex string")
    if category:
        df = df.where(F.col("category") == category)
    return df.where(F.col("severity") == severity) if severity else df


def pattern_rollup(findings: DataFrame) -> DataFrame:
    """Per pattern: matches, first and last time seen; ``findings(pattern, created_at, …)``."""
    return findings.groupBy("pattern").agg(
        F.count("*").alias("match_count"), F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"),
    )


def flatten_findings(scans: DataFrame, limit: int = 20) -> DataFrame:
    """The newest hidden-instruction findings, one per row; ``scans(doc_id, created_at, risk_score, findings ARRAY)``.

    Only scans that can reach the limit are exploded.
    """
    newest = scans.where(F.size("findings") > 0).orderBy(F.col("created_at").desc(), "doc_id").limit(limit)
    return newest.select(
        "doc_id", F.coalesce("risk_score", F.lit(0.85)).alias("confidence"), F.col("created_at").alias("detected_at"),
        F.posexplode("findings").alias("nth", "snippet"),
    ).orderBy(F.col("detected_at").desc(), "doc_id", "nth").limit(limit)


def relabel(scans: DataFrame) -> DataFrame:
    """Display labels: threat type per engine, display severity, document and tool bands."""
    severity = F.when(F.col("severity").isin("critical", "high"), "critical").when(F.col("severity") == "medium", "warning")
    points = F.floor(F.col("risk_score") * 100 + 0.5)
    return scans.withColumns(
        {
            "threat_type": _map(cat.ENGINE_THREATS)[F.col("engine")],
            "display_severity": severity.when(F.col("severity") == "low", "info").otherwise(F.col("severity")),
            "rag_label": banded(F.col("risk_score"), (0.7, "malicious"), (0.3, "suspicious"), otherwise="clean"),
            "tool_label": banded(points, (80, "critical"), (50, "warning"), (20, "info"), otherwise="safe"),
        }
    )


def kpi_counts(df: DataFrame, column: str, by: Sequence[str] = ("tenant_id",)) -> DataFrame:
    """Rows per value of a verdict, severity or flag column."""
    return df.groupBy(*by, column).agg(F.count("*").alias("count"))
