"""Agent telemetry: span anomalies, root causes, distribution shift and reports.

``spans(span_id, trace_id, event_type, agent_id, ts, duration_ms, risk_score, denied,
reward_signal, quality_score, tool_name, …)``. Dataset-wide statistics are single rows; they
are read once and used as literals, so annotating is a scan plus one join on time buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkpoison.functions import catalogue as cat
from sparkpoison.functions.numeric import cap1, clip01, round_to, share
from sparkpoison.functions.stats import percentiles
from sparkpoison.session import broadcast_if_small, checkpoint

RISK_SPIKE = 0.65
ROOT_RISK = 0.60
AMPLIFYING_RISK = 0.40
DENIAL_BASELINE = 0.05
LATENCY_Z = 10.0
LATENCY_FACTOR = 4.0
COLLUSION_SECONDS = 60
REWARD_GAP = 0.35
_EPS = 1e-10


def _flag(spans: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False)) if name in spans.columns else F.lit(False)


def risk_stats(spans: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """mean, std, p95, p99 of the risk score to four places."""
    by = list(by)
    moments = spans.groupBy(*by).agg(
        round_to(F.avg("risk_score"), 4).alias("mean"), round_to(F.stddev_pop("risk_score"), 4).alias("std")
    )
    tails = percentiles(spans, "risk_score", {"p95": 0.95, "p99": 0.99}, by)
    tails = tails.withColumns({c: round_to(c, 4) for c in ("p95", "p99")})
    if by:
        return moments.join(tails, by)
    return moments.select("*", tails.select(F.struct("p95", "p99")).scalar().alias("_t")).select(
        "mean", "std", "_t.p95", "_t.p99"
    )


def denial_rate(spans: DataFrame) -> Column:
    calls = F.col("event_type") == "tool_call"
    return share(F.count_if(calls & _flag(spans, "denied")), F.count_if(calls))


def latency_scale(spans: DataFrame) -> tuple[float, float]:
    """(median, median absolute deviation) of the durations."""
    median = percentiles(spans, "duration_ms", {"m": 0.5}).first()
    if median is None or median["m"] is None:
        return 0.0, 0.0
    gaps = spans.select(F.abs(F.col("duration_ms") - median["m"]).alias("gap"))
    return median["m"], percentiles(gaps, "gap", {"m": 0.5}).first()["m"]


def time_bucket(ts: Column | str, seconds: int = COLLUSION_SECONDS) -> Column:
    return F.floor(F.unix_micros(ts) / (seconds * 1_000_000)).cast("bigint")


def annotate_spans(spans: DataFrame) -> DataFrame:
    """Adds anomaly_types and is_anomalous to every span.

    Collusion looks at the anomalies found before reward hacking, which is added last.
    """
    surge = (spans.agg(denial_rate(spans).alias("d")).first()["d"] or 0.0) > 3.0 * DENIAL_BASELINE
    median, mad = latency_scale(spans)
    z = 0.6745 * (F.col("duration_ms") - median) / mad if mad >= 1e-12 else F.lit(0.0)
    slow = (F.abs(z) > LATENCY_Z) & (F.col("duration_ms") > LATENCY_FACTOR * median)
    first = F.array_compact(
        F.array(
            F.when(F.col("risk_score") > RISK_SPIKE, "prompt_risk_spike"),
            F.when(F.lit(surge) & (F.col("event_type") == "tool_call") & _flag(spans, "denied"), "tool_denial_surge"),
            F.when(slow, "latency_anomaly"),
            F.when(_flag(spans, "memory_corrupted"), "memory_corruption"),
            F.when(_flag(spans, "retrieval_hijacked"), "retrieval_hijack"),
            F.when(_flag(spans, "reward_hacked"), "reward_hacking"),
            F.when(_flag(spans, "colluding"), "multi_agent_collusion"),
        )
    )
    base = spans.withColumn("_types", first).withColumn("_bucket", time_bucket("ts"))
    crowds = (
        base.where(F.size("_types") > 0).groupBy("_bucket")
        .agg(F.count_distinct("agent_id").alias("_agents")).where(F.col("_agents") >= 3).select("_bucket", "_agents")
    )
    joined = base.join(broadcast_if_small(checkpoint(crowds)), "_bucket", "left")
    together = (F.size("_types") > 0) & F.col("_agents").isNotNull()
    hacking = (F.col("event_type") == "agent_decision") & (
        F.coalesce("reward_signal", F.lit(0.0)) - F.coalesce("quality_score", F.lit(0.0)) > REWARD_GAP
    )
    added = F.array_compact(F.array(F.when(together, "multi_agent_collusion"), F.when(hacking, "reward_hacking")))
    return (
        joined.withColumn("anomaly_types", F.array_distinct(F.concat("_types", added)))
        .withColumn("is_anomalous", F.size("anomaly_types") > 0)
        .drop("_types", "_bucket", "_agents")
    )


def anomaly_breakdown(annotated: DataFrame) -> DataFrame:
    """Spans per anomaly type, every type present."""
    spark = annotated.sparkSession
    kinds = spark.range(1).select(F.explode(F.array(*map(F.lit, cat.ANOMALY_TYPES))).alias("anomaly_type"))
    counts = annotated.select(F.explode("anomaly_types").alias("anomaly_type")).groupBy("anomaly_type").agg(
        F.count("*").alias("spans")
    )
    return counts.join(kinds, "anomaly_type", "right").na.fill(0, ["spans"])


# --------------------------------------------------------------------------- root cause

def root_cause(spans: DataFrame) -> DataFrame:
    """Per trace the span that started the trouble, with a confidence.

    The root is the earliest span of risk ≥ 0.60 that has a later one of risk ≥ 0.40, i.e.
    the earliest of the first kind when it precedes the last of the second. Both are
    aggregates, so a trace of any length combines before the shuffle and no trace is sorted.
    """
    at = F.struct("ts", "span_id")
    hot, warm = F.col("risk_score") >= ROOT_RISK, F.col("risk_score") >= AMPLIFYING_RISK
    heads = spans.groupBy("trace_id").agg(
        F.min(F.when(hot, F.struct("ts", "span_id", "risk_score"))).alias("first_hot"),
        F.max(F.when(warm, at)).alias("last_warm"),
        # the earliest among the riskiest spans
        F.min(F.struct((-F.col("risk_score")).alias("neg"), "ts", "span_id")).alias("peak"),
    )
    starts = F.struct("first_hot.ts", "first_hot.span_id") < F.col("last_warm")
    heads = heads.select("trace_id", F.when(starts, F.col("first_hot")).alias("root"), "peak")
    rooted = heads.where(F.col("root").isNotNull()).select("trace_id", "root")
    after = (
        spans.where(warm).join(rooted, "trace_id")
        .where(at > F.struct("root.ts", "root.span_id"))
        .groupBy("trace_id").agg(F.count("*").alias("amplifying"), F.avg("risk_score").alias("mean_after"))
    )
    joined = heads.join(after, "trace_id", "left")
    spread = 0.5 * (F.col("root.risk_score") - ROOT_RISK) / (1.0 - ROOT_RISK) + 0.5 * cap1(
        F.col("amplifying") / 3.0
    ) * F.col("mean_after")
    peak = -F.col("peak.neg")
    return joined.select(
        "trace_id",
        F.when(F.col("root").isNotNull(), F.col("root.span_id")).when(peak > 0, F.col("peak.span_id")).alias("root_span_id"),
        round_to(F.when(F.col("root").isNotNull(), clip01(spread)).when(peak > 0, peak * 0.3).otherwise(0.0), 4).alias("confidence"),
        F.coalesce("amplifying", F.lit(0)).alias("amplifying"),
        F.col("root").isNotNull().alias("is_propagating"),
    )


def propagation_path(spans: DataFrame, roots: DataFrame) -> DataFrame:
    """The spans of risk ≥ 0.40 after each propagating root, one row each (never gathered per trace)."""
    roots = roots.where("is_propagating").select("trace_id", "root_span_id")
    started = spans.select("trace_id", F.col("span_id").alias("root_span_id"), F.col("ts").alias("root_ts")).join(
        roots, ["trace_id", "root_span_id"]
    )
    later = F.struct("ts", "span_id") > F.struct("root_ts", "root_span_id")
    return (
        spans.where(F.col("risk_score") >= AMPLIFYING_RISK).join(started, "trace_id").where(later)
        .select("trace_id", "root_span_id", "span_id", "ts", "risk_score")
    )


def trace_summary(annotated: DataFrame) -> DataFrame:
    return annotated.groupBy("trace_id").agg(
        F.min("ts").alias("ts"), F.max("risk_score").alias("risk_score"), F.max("is_anomalous").alias("is_anomalous"),
        F.sum("duration_ms").alias("total_duration_ms"), F.count("*").alias("spans"),
    )


def rank_root_causes(annotated: DataFrame, limit: int = 25) -> DataFrame:
    """The anomalous traces with a root cause, riskiest first."""
    rows = trace_summary(annotated).where("is_anomalous").join(root_cause(annotated), "trace_id")
    return (
        rows.where(F.col("root_span_id").isNotNull()).orderBy(F.col("risk_score").desc(), "trace_id").limit(limit)
        .select("trace_id", "risk_score", "root_span_id", "confidence")
    )


# --------------------------------------------------------------------------- shift

def bin_edges(lo: float, hi: float, bins: int) -> list[float]:
    """Edges as ``lo + i·step``, the last one exact."""
    hi = max(hi, lo + 1e-6)
    step = (hi - lo) / bins
    return [lo + i * step for i in range(bins)] + [hi]


def bin_of(value: Column, edges: Sequence[float]) -> Column:
    """Index of the half-open bin holding the value (the last bin is closed), null outside."""
    expr = F.when((value < edges[0]) | (value > edges[-1]), None)
    for i, edge in enumerate(edges[1:-1]):
        expr = expr.when(value < edge, i)
    return expr.otherwise(len(edges) - 2)


def _kl(counts: DataFrame, p: str, q: str) -> DataFrame:
    """KL(p ‖ q) in nats of two count columns, each count shifted by 1e-10 before normalising."""
    total = counts.agg(F.sum(F.col(p) + _EPS).alias("tp"), F.sum(F.col(q) + _EPS).alias("tq"))
    sums = counts.select("*", total.select(F.struct("tp", "tq")).scalar().alias("_t"))
    a, b = (F.col(p) + _EPS) / F.col("_t.tp"), (F.col(q) + _EPS) / F.col("_t.tq")
    return sums.agg(F.coalesce(F.sum(a * F.log(a / b)), F.lit(0.0)).alias("kl"))


def _bins(spark, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias("bin"))


def beta_2_8_mass(edges: Sequence[float]) -> list[float]:
    """Probability of Beta(2, 8) per bin, from its closed-form distribution function."""
    cdf = [1 - (1 - x) ** 9 - 9 * x * (1 - x) ** 8 for x in edges]
    return [b - a for a, b in zip(cdf, cdf[1:])]


def shift_vs_beta(spans: DataFrame) -> DataFrame:
    """Shift of the risk scores from clean Beta(2, 8) traffic, in [0, 1]."""
    edges = bin_edges(0.0, 1.0, 20)
    masses = F.array(*[F.lit(m) for m in beta_2_8_mass(edges)])
    seen = spans.groupBy(bin_of(F.col("risk_score"), edges).alias("bin")).agg(F.count("*").alias("c"))
    n = spans.agg(F.greatest(F.count("*"), F.lit(500)).alias("n"))
    counts = _bins(spans.sparkSession, 20).join(seen, "bin", "left").select(
        (masses[F.col("bin")] * n.scalar()).alias("p"), F.coalesce("c", F.lit(0)).cast("double").alias("q")
    )
    return _kl(counts, "p", "q").select(clip01(F.col("kl") / 2.0).alias("shift_score"))


def _histogram_kl(base: DataFrame, current: DataFrame, value: Column, edges: Sequence[float]) -> DataFrame:
    both = base.select(value.alias("v"), F.lit(0).alias("side")).union(current.select(value, F.lit(1)))
    seen = both.groupBy(bin_of(F.col("v"), edges).alias("bin")).agg(
        F.count_if(F.col("side") == 0).alias("p"), F.count_if(F.col("side") == 1).alias("q")
    )
    counts = _bins(base.sparkSession, len(edges) - 1).join(seen, "bin", "left").na.fill(0)
    return _kl(counts.select(F.col("p").cast("double").alias("p"), F.col("q").cast("double").alias("q")), "p", "q")


def _category_kl(base: DataFrame, current: DataFrame, key: Column) -> DataFrame:
    count = lambda df, name: df.groupBy(key.alias("k")).agg(F.count("*").cast("double").alias(name))
    both = count(base, "p").join(count(current, "q"), "k", "full_outer").na.fill(0.0, ["p", "q"])
    return _kl(both, "p", "q")


def distribution_shift(base: DataFrame, current: DataFrame) -> DataFrame:
    """KL divergences of risk, latency, tool use and agent activity between two windows, and a verdict."""
    latency = F.log1p("duration_ms")
    tops = [df.agg(F.coalesce(F.max(latency), F.lit(0.0)).alias("m")).first()["m"] for df in (base, current)]
    import math

    hi = math.log1p(max(tops) + 1.0)
    tool = F.coalesce("tool_name", F.lit("unknown"))
    calls = lambda df: df.where(F.col("event_type") == "tool_call")
    parts = {
        "risk_score_kl": _histogram_kl(base, current, F.col("risk_score"), bin_edges(0.0, 1.0, 20)),
        "latency_kl": _histogram_kl(base, current, latency, bin_edges(0.0, hi, 20)),
        "tool_frequency_kl": _category_kl(calls(base), calls(current), tool),
        "agent_activity_kl": _category_kl(base, current, F.col("agent_id")),
    }
    row = base.sparkSession.range(1).select(*[df.scalar().alias(n) for n, df in parts.items()])
    weights = dict(zip(parts, (0.35, 0.30, 0.20, 0.15)))
    overall = sum((w * clip01(F.col(n) / 2.0) for n, w in weights.items()), F.lit(0.0))
    return row.select(
        *[round_to(n, 6).alias(n) for n in parts], round_to(overall, 4).alias("overall_shift_score"),
        F.when(overall < 0.20, "stable").when(overall < 0.50, "drifting").otherwise("shifted").alias("verdict"),
    )


# --------------------------------------------------------------------------- reports

def dataset_risk(annotated: DataFrame) -> DataFrame:
    """One row: anomalous traces, rates, shift, risk and verdict of the whole set of spans."""
    # Read six times below; written once so the annotation is not repeated.
    annotated = checkpoint(
        annotated.select("trace_id", "event_type", "risk_score", "denied", "duration_ms", "is_anomalous")
    )
    traces = trace_counts(annotated)
    spans = annotated.agg(
        F.count("*").alias("total_spans"), denial_rate(annotated).alias("denial"), F.avg("duration_ms").alias("avg_ms"),
    )
    row = traces.select(
        "*", spans.select(F.struct("*")).scalar().alias("s"),
        risk_stats(annotated).select("p95").scalar().alias("p95"),
        shift_vs_beta(annotated).scalar().alias("shift"),
        percentiles(annotated, "duration_ms", {"p": 0.99}).scalar().alias("ms99"),
    )
    risk = clip01(
        0.40 * share(F.col("anomalous_traces"), F.col("total_traces")) + 0.25 * cap1(F.col("shift"))
        + 0.20 * cap1(F.col("p95") / RISK_SPIKE) + 0.15 * cap1(F.col("s.denial") / (3.0 * DENIAL_BASELINE))
    )
    return row.withColumn("_risk", risk).select(
        "total_traces", "s.total_spans", "anomalous_traces", round_to("s.denial", 4).alias("tool_denial_rate"),
        round_to("s.avg_ms", 3).alias("avg_latency_ms"), round_to("ms99", 3).alias("latency_p99_ms"),
        round_to("shift", 4).alias("distribution_shift_score"), round_to("_risk", 4).alias("risk_score"),
        F.when(F.col("_risk") < 0.25, "clean").when(F.col("_risk") < 0.55, "suspicious").otherwise("poisoned").alias("verdict"),
    )


def trace_counts(annotated: DataFrame) -> DataFrame:
    per = annotated.groupBy("trace_id").agg(F.max("is_anomalous").alias("bad"))
    return per.agg(F.count("*").alias("total_traces"), F.count_if("bad").alias("anomalous_traces"))


def timeline(annotated: DataFrame) -> DataFrame:
    """All spans in time order (a range-partitioned sort)."""
    is_call, is_read = F.col("event_type") == "tool_call", F.col("event_type") == "rag_retrieval"
    doc = F.when(is_read, F.col("doc_id")) if "doc_id" in annotated.columns else F.lit(None).cast("string")
    return annotated.select(
        "ts", "trace_id", "span_id", "agent_id", "event_type", round_to("duration_ms", 3).alias("duration_ms"),
        round_to("risk_score", 4).alias("risk_score"), "is_anomalous", "anomaly_types",
        F.when(is_call, F.col("tool_name")).alias("tool_name"), doc.alias("doc_id"),
    ).orderBy("ts", "span_id")


def span_report_edge(annotated: DataFrame) -> DataFrame:
    """One row with nearest-rank percentiles; denied means a tool call of risk over 0.5."""
    call = F.col("event_type") == "tool_call"
    base = annotated.agg(
        F.count_distinct("trace_id").alias("total_traces"), F.count("*").alias("total_spans"),
        F.count_if("is_anomalous").alias("anomalous_spans"), round_to(F.avg("risk_score"), 4).alias("risk_mean"),
        round_to(F.stddev_pop("risk_score"), 4).alias("risk_std"),
        round_to(share(F.count_if(call & (F.col("risk_score") > 0.5)), F.count_if(call)), 4).alias("tool_denial_rate"),
        round_to(F.avg("duration_ms"), 1).alias("latency_mean"),
    )
    tails = {"p95": 0.95, "p99": 0.99}
    risk = percentiles(annotated, "risk_score", tails, method="nearest").select(F.struct("p95", "p99")).scalar()
    lat = percentiles(annotated, "duration_ms", tails, method="nearest").select(F.struct("p95", "p99")).scalar()
    rate = share(F.col("anomalous_spans"), F.col("total_spans"))
    return base.select("*", risk.alias("r"), lat.alias("l")).select(
        *base.columns, round_to("r.p95", 4).alias("risk_p95"), round_to("r.p99", 4).alias("risk_p99"),
        F.col("l.p95").alias("latency_p95"), F.col("l.p99").alias("latency_p99"), round_to(rate, 4).alias("anomalous_rate"),
        F.when(rate < 0.05, "clean").when(rate < 0.15, "suspicious").otherwise("poisoned").alias("verdict"),
    )


def top_flags(annotated: DataFrame, limit: int = 10) -> DataFrame:
    return (
        annotated.select(F.explode("anomaly_types").alias("flag")).groupBy("flag").agg(F.count("*").alias("count"))
        .orderBy(F.col("count").desc(), "flag").limit(limit)
    )


def bucket_timeline(traces: DataFrame, buckets: int = 40) -> DataFrame:
    """Equal-width half-open time buckets with mean risk and counts; a trace at the very end falls outside."""
    ms = F.unix_millis("ts")
    span = traces.agg(F.min(ms).alias("lo"), F.max(ms).alias("hi")).select(F.struct("lo", "hi")).scalar()
    placed = traces.select("*", span.alias("_s")).withColumn(
        "_w", F.greatest((F.col("_s.hi") - F.col("_s.lo")) / float(buckets), F.lit(1.0))
    )
    at = F.floor((ms - F.col("_s.lo")) / F.col("_w")).cast("int")
    seen = placed.withColumn("bin", at).groupBy("bin").agg(
        round_to(F.avg("risk_score"), 4).alias("avg_risk"), F.count_if("is_anomalous").alias("anomalous_count"),
        F.count_if(~F.col("is_anomalous")).alias("normal_count"),
    )
    return _bins(traces.sparkSession, buckets).join(seen, "bin", "left").na.fill(0)
