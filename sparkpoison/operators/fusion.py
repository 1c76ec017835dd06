"""Fusing the engines' results into threats, scores, trends and recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkpoison.functions import catalogue as cat
from sparkpoison.functions.numeric import banded, cap1, round_to
from sparkpoison.functions.stats import with_position
from sparkpoison.operators.drift import ago

_ENGINES = list(cat.ENGINE_WEIGHTS)
_PREFIX = {"vector_analyzer": "VEC", "rag_analyzer": "RAG", "mcp_auditor": "MCP", "provenance_tracker": "PRV"}


def finding_severity(score: Column) -> Column:
    return banded(score, (0.85, "critical"), (0.60, "high"), (0.35, "medium"), otherwise="low")


def overall_severity(score: Column) -> Column:
    return banded(score, (0.80, "critical"), (0.55, "high"), (0.30, "medium"), otherwise="low")


def unify_threats(vector: DataFrame, rag: DataFrame, mcp: DataFrame, provenance: DataFrame) -> DataFrame:
    """One row per finding that passes its engine's gate, numbered per tenant in engine order.

    ``vector(tenant_id, vec_id, anomaly_score, cosine_deviation, reasons)``,
    ``rag(tenant_id, doc_id, risk_score, is_suspicious, signals, hidden)``,
    ``mcp(tenant_id, tool_id, tool_name, risk_score, verdict, findings)``,
    ``provenance(tenant_id, dataset_id, max_decayed_score, is_contaminated, paths)``.
    """

    def threats(df: DataFrame, engine: str, entity: str, score: str, category: Column, title: Column, text: Column, evidence: Column) -> DataFrame:
        return df.select(
            "tenant_id", F.lit(_ENGINES.index(engine)).alias("_order"), F.lit(engine).alias("source_engine"),
            F.col(entity).cast("string").alias("entity_id"), F.col(entity).try_cast("bigint").alias("_entity"),
            category.alias("category"), F.col(score).alias("score"), title.alias("title"),
            text.alias("description"), evidence.alias("evidence"),
            F.lit(cat.ENGINE_ACTIONS[engine]).alias("recommended_action"),
        )

    rows = (
        threats(
            vector.where(F.col("anomaly_score") > 0.3), "vector_analyzer", "vec_id", "anomaly_score",
            F.lit("vector_poisoning"),
            F.format_string("Anomalous embedding vector (index %s)", F.col("vec_id").cast("string")),
            F.when(F.size("reasons") > 0, F.array_join("reasons", "; ")).otherwise("Vector flagged by anomaly detection"),
            F.concat(F.lit("cosine_deviation="), F.coalesce(F.col("cosine_deviation").cast("string"), F.lit("N/A"))),
        )
        .unionByName(threats(
            rag.where("is_suspicious"), "rag_analyzer", "doc_id", "risk_score",
            F.when(F.col("hidden") > 0, "prompt_injection").otherwise("rag_injection"),
            F.lit("Suspicious RAG document detected"),
            F.concat(F.lit("Triggered signals: "), F.array_join("signals", ", ")),
            F.concat(F.lit("hidden_instructions="), F.col("hidden").cast("string")),
        ))
        .unionByName(threats(
            mcp.where(F.col("risk_score") > 0.2), "mcp_auditor", "tool_id", "risk_score", F.lit("mcp_tool_attack"),
            F.concat(F.lit("Suspicious MCP tool: "), "tool_name"),
            F.format_string("Verdict: %s. %d finding(s).", "verdict", F.col("findings").cast("bigint")),
            F.concat(F.lit("tool="), "tool_name"),
        ))
        .unionByName(threats(
            provenance.where("is_contaminated"), "provenance_tracker", "dataset_id", "max_decayed_score",
            F.lit("data_contamination"),
            F.concat(F.lit("Contaminated dataset: "), F.col("dataset_id").cast("string")),
            F.format_string("%d contamination path(s) detected in ancestry.", F.col("paths").cast("bigint")),
            F.concat(F.lit("dataset="), F.col("dataset_id").cast("string")),
        ))
    )
    numbered = with_position(rows, ["tenant_id"], [F.col("_order"), F.col("_entity"), F.col("entity_id")])
    prefix = F.create_map(*[F.lit(x) for pair in _PREFIX.items() for x in pair])
    return numbered.select(
        "tenant_id", F.format_string("%s-%04d", prefix[F.col("source_engine")], F.col("pos")).alias("threat_id"),
        "source_engine", "entity_id", "category", finding_severity(F.col("score")).alias("severity"), "score",
        "title", "description", "evidence", "recommended_action",
    )


def unified_score(scores: DataFrame) -> DataFrame:
    """Weighted sum of each engine's highest score per tenant; ``scores(tenant_id, engine, score)``."""
    weights = F.create_map(*[F.lit(x) for pair in cat.ENGINE_WEIGHTS.items() for x in pair])
    top = scores.groupBy("tenant_id", "engine").agg(F.max("score").alias("m"))
    total = top.groupBy("tenant_id").agg(F.sum(F.coalesce(weights[F.col("engine")], F.lit(0.0)) * F.col("m")).alias("s"))
    capped = cap1(F.col("s"))
    return total.select("tenant_id", round_to(capped, 4).alias("unified_score"), overall_severity(capped).alias("severity"))


def engine_summaries(scores: DataFrame, threats: DataFrame) -> DataFrame:
    """Per tenant and engine, present or not: findings by severity, highest score, weighted share."""
    weights = F.create_map(*[F.lit(x) for pair in cat.ENGINE_WEIGHTS.items() for x in pair])
    top = scores.groupBy("tenant_id", "engine").agg(F.max("score").alias("_max"))
    counts = threats.groupBy("tenant_id", F.col("source_engine").alias("engine")).agg(
        F.count("*").alias("finding_count"), F.count_if(F.col("severity") == "critical").alias("critical_count"),
        F.count_if(F.col("severity") == "high").alias("high_count"),
    )
    grid = scores.select("tenant_id").distinct().withColumn("engine", F.explode(F.array(*map(F.lit, _ENGINES))))
    out = grid.join(top, ["tenant_id", "engine"], "left").join(counts, ["tenant_id", "engine"], "left").na.fill(0)
    return out.select(
        "tenant_id", "engine", "finding_count", "critical_count", "high_count", round_to("_max", 4).alias("max_score"),
        round_to(weights[F.col("engine")] * F.col("_max"), 4).alias("weighted_contribution"),
    )


#: rows per window task of ``trend``
_CHUNK = 10_000


def trend_of(current: Column, mean: Column, seen: Column) -> Column:
    """Direction of a score against the mean of the ``seen`` scores before it."""
    change = round_to((current - mean) / mean, 9)
    return (
        F.when(seen < 2, "insufficient_data")
        .when(mean < 1e-6, F.when(current < 0.05, "stable").otherwise("degrading"))
        .when(change < -0.10, "improving").when(change > 0.10, "degrading").otherwise("stable")
    )


def trend(history: DataFrame, at: str = "at", size: int = 30) -> DataFrame:
    """Trend of every score of ``history(tenant_id, at, score)`` against the up to 29 before it.

    A tenant's history is cut into runs of 10,000 that share 29 rows with the run before, so a
    tenant with most of the rows is still many tasks.
    """
    back = size - 1
    tie = [F.col(c) for c in history.columns if c not in ("tenant_id", at, "score")]
    placed = with_position(history, ["tenant_id"], [F.col(at), *tie])
    chunk = F.floor((F.col("pos") - 1) / _CHUNK)
    tail = (F.col("pos") - 1) % _CHUNK >= _CHUNK - back
    spread = placed.withColumn("_own", chunk).withColumn(
        "_chunk", F.explode(F.when(tail, F.array(chunk, chunk + 1)).otherwise(F.array(chunk)))
    )
    w = Window.partitionBy("tenant_id", "_chunk").orderBy("pos").rowsBetween(-back, -1)
    out = spread.withColumns({"_mean": F.avg("score").over(w), "_seen": F.count("score").over(w)})
    return (
        out.where(F.col("_own") == F.col("_chunk"))
        .withColumn("trend", trend_of(F.col("score"), F.col("_mean"), F.col("_seen")))
        .drop("_own", "_chunk", "_mean", "_seen")
    )


def recommendations(threats: DataFrame) -> DataFrame:
    """Distinct actions per tenant by their best threat; incident response first if any is critical."""
    best = threats.groupBy("tenant_id", "source_engine", F.col("recommended_action").alias("action")).agg(
        F.max("score").alias("score")
    )
    alarm = threats.where(F.col("severity") == "critical").select("tenant_id").distinct().select(
        "tenant_id", F.lit("").alias("source_engine"), F.lit(cat.INCIDENT_ACTION).alias("action"), F.lit(9.0).alias("score")
    )
    order = F.array_position(F.array(*map(F.lit, ["", *_ENGINES])), F.col("source_engine"))
    w = Window.partitionBy("tenant_id").orderBy(F.col("score").desc(), order)
    return best.unionByName(alarm).select("tenant_id", F.row_number().over(w).alias("priority"), "action")


# --------------------------------------------------------------------------- edge profile

def threat_report_edge(records: DataFrame, contaminated: DataFrame, as_of: str, hours: int = 24, include_clean: bool = False, limit: int | None = 50) -> DataFrame:
    """Per tenant and engine the mean of the window's ``limit`` highest scores, verdicts and counts.

    50 is the published rule; None takes all. Of equal scores the newer, then the smaller verdict counts first.

    ``records(tenant_id, engine, risk_score, verdict, created_at)`` with engine vector, rag or mcp;
    ``contaminated(tenant_id, severity, created_at)``.
    """
    since = ago(as_of, hours, "HOURS")
    w = Window.partitionBy("tenant_id", "engine").orderBy(F.col("risk_score").desc(), F.col("created_at").desc(), "verdict")
    first = lambda df, order: df if limit is None else df.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= limit)
    top = first(records.where(F.col("created_at") >= since), w)
    counted = F.lit(True) if include_clean else F.col("risk_score") >= 0.3
    engines = top.groupBy("tenant_id", "engine").agg(
        F.coalesce(F.avg(F.when(counted, F.col("risk_score"))), F.lit(0.0)).alias("score"),
        F.count("*").alias("record_count"), F.count_if(~F.col("verdict").eqNullSafe("clean")).alias("flagged_count"),
    )
    weight = F.create_map(*[F.lit(x) for pair in cat.CONTAMINATION_SEVERITY.items() for x in pair])
    wp = Window.partitionBy("tenant_id").orderBy(F.col("created_at").desc(), "severity")
    nodes = (
        first(contaminated.where(F.col("created_at") >= since), wp).groupBy("tenant_id").agg(
            F.avg(F.coalesce(weight[F.col("severity")], F.lit(0.2))).alias("score"), F.count("*").alias("record_count"),
            F.count_if(F.col("severity").isin("critical", "high")).alias("flagged_count"),
        ).withColumn("engine", F.lit("provenance"))
    )
    tenants = records.select("tenant_id").union(contaminated.select("tenant_id")).distinct()
    grid = tenants.withColumn("engine", F.explode(F.array(*map(F.lit, cat.EDGE_ENGINE_WEIGHTS))))
    out = grid.join(engines.unionByName(nodes), ["tenant_id", "engine"], "left").na.fill(0)
    s = F.col("score")
    mcp = banded(s, (0.5, "malicious"), (0.2, "suspicious"), otherwise="clean")
    prov = banded(s, (0.6, "contaminated"), (0.3, "suspicious"), otherwise="clean")
    rest = banded(s, (0.6, "poisoned"), (0.3, "suspicious"), otherwise="clean")
    verdict = F.when(F.col("engine") == "mcp", mcp).when(F.col("engine") == "provenance", prov).otherwise(rest)
    return out.withColumn("verdict", verdict)


def threat_score_edge(report: DataFrame) -> DataFrame:
    weights = F.create_map(*[F.lit(x) for pair in cat.EDGE_ENGINE_WEIGHTS.items() for x in pair])
    total = report.groupBy("tenant_id").agg(F.sum(weights[F.col("engine")] * F.col("score")).alias("s"))
    return total.select("tenant_id", round_to("s", 4).alias("unified_score"), overall_severity(F.col("s")).alias("severity"))


def recommendations_edge(report: DataFrame) -> DataFrame:
    """Distinct recommendations by engine and score tier, from a list of a dozen rules."""
    tiers = [
        F.when(
            (F.col("engine") == engine) & (F.col("score") >= low) & (F.col("score") < high),
            F.struct(F.lit(part).alias("part"), F.lit(text).alias("recommendation")),
        )
        for engine, low, high, part, text in cat.EDGE_RECOMMENDATIONS
    ]
    hit = report.select("tenant_id", "engine", F.explode(F.array_compact(F.array(*tiers))).alias("r"))
    return hit.select("tenant_id", "engine", "r.part", "r.recommendation").distinct()


def scan_summary(scans: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """Per tenant totals by verdict and a map of counts by engine."""
    recent = scans.where(F.col("created_at") >= ago(as_of, hours, "HOURS"))
    v = F.col("verdict")
    per = recent.groupBy("tenant_id", "engine").agg(
        F.count("*").alias("n"), F.count_if(v == "clean").alias("clean"), F.count_if(v == "suspicious").alias("suspicious"),
        F.count_if(v.isin("poisoned", "malicious", "contaminated")).alias("poisoned"),
    )
    return per.groupBy("tenant_id").agg(
        F.sum("n").alias("total"), *[F.sum(c).alias(c) for c in ("clean", "suspicious", "poisoned")],
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("engine", "n")))).alias("by_type"),
    )
