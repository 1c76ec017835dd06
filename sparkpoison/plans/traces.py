"""Agent-telemetry queries with their check SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sparkpoison.functions.numeric import round_to
from sparkpoison.operators import traces as tr
from sparkpoison.plans.registry import query
from sparkpoison.plans.views import r

_ANN = """
den AS (SELECT count_if(event_type = 'tool_call' AND denied) / nullif(count_if(event_type = 'tool_call'), 0) AS rate FROM spans),
med AS (SELECT quantile_cont(duration_ms, 0.5) AS m FROM spans),
mad AS (SELECT quantile_cont(abs(duration_ms - m), 0.5) AS d FROM spans, med),
f AS (SELECT spans.*, risk_score > 0.65 AS t1, rate > 0.15 AND event_type = 'tool_call' AND denied AS t2,
  CASE WHEN d >= 1e-12 THEN abs(CAST(0.6745 AS DOUBLE) * (duration_ms - m) / d) > 10 ELSE false END AND duration_ms > 4 * m AS t3,
  memory_corrupted AS t4, retrieval_hijacked AS t5, epoch_us(ts) // 60000000 AS bucket FROM spans, den, med, mad),
g AS (SELECT *, t1 OR t2 OR t3 OR t4 OR t5 AS pre FROM f),
crowd AS (SELECT bucket FROM g WHERE pre GROUP BY bucket HAVING count(DISTINCT agent_id) >= 3),
h AS (SELECT *, pre AND bucket IN (SELECT bucket FROM crowd) AS t6, event_type = 'agent_decision' AND reward_signal - quality_score > CAST(0.35 AS DOUBLE) AS t7 FROM g),
ann AS (SELECT *, concat_ws(',', CASE WHEN t1 THEN 'prompt_risk_spike' END, CASE WHEN t2 THEN 'tool_denial_surge' END, CASE WHEN t3 THEN 'latency_anomaly' END,
  CASE WHEN t4 THEN 'memory_corruption' END, CASE WHEN t5 THEN 'retrieval_hijack' END, CASE WHEN t6 THEN 'multi_agent_collusion' END, CASE WHEN t7 THEN 'reward_hacking' END) AS types,
  pre OR t7 AS is_anomalous FROM h)"""

_ROOT = f"""
o AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY ts, span_id) AS k FROM spans),
am AS (SELECT a.trace_id, a.span_id, a.k, a.risk_score, count(b.k) AS n, avg(b.risk_score) AS m FROM o a
  LEFT JOIN o b ON b.trace_id = a.trace_id AND b.k > a.k AND b.risk_score >= 0.4 WHERE a.risk_score >= CAST(0.6 AS DOUBLE) GROUP BY ALL),
rt AS (SELECT * FROM am WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY k) = 1),
pk AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY risk_score DESC, k) = 1),
root AS (SELECT pk.trace_id, CASE WHEN rt.span_id IS NOT NULL THEN rt.span_id WHEN pk.risk_score > 0 THEN pk.span_id END AS root_span_id,
  {r("CASE WHEN rt.span_id IS NOT NULL THEN least(greatest(CAST(0.5 AS DOUBLE) * (rt.risk_score - CAST(0.6 AS DOUBLE)) / (1.0 - CAST(0.6 AS DOUBLE)) + CAST(0.5 AS DOUBLE) * least(n / 3.0, 1.0) * m, 0.0), 1.0) WHEN pk.risk_score > 0 THEN pk.risk_score * CAST(0.3 AS DOUBLE) ELSE 0 END", 4)} AS confidence,
  coalesce(n, 0) AS amplifying, rt.span_id IS NOT NULL AS is_propagating FROM pk LEFT JOIN rt ON rt.trace_id = pk.trace_id)"""


def _edges_sql(bins: int = 20) -> str:
    return "[" + ", ".join(f"CAST({e!r} AS DOUBLE)" for e in tr.bin_edges(0.0, 1.0, bins)) + "]"


def _bin_sql(value: str, edges: str) -> str:
    """Index of the half-open bin (last closed), null outside."""
    return (f"CASE WHEN {value} < {edges}[1] OR {value} > {edges}[-1] THEN NULL "
            f"ELSE least(len(list_filter({edges}, lambda e: e <= {value})) - 1, len({edges}) - 2) END")


def _kl_sql(table: str) -> str:
    return f"(SELECT coalesce(sum(a * ln(a / b)), 0) FROM (SELECT (p + 1e-10) / sum(p + 1e-10) OVER () AS a, (q + 1e-10) / sum(q + 1e-10) OVER () AS b FROM {table}))"


_BETA = f"""
be AS (SELECT unnest(range(0, 20)) AS bin, unnest([{", ".join(repr(m) for m in tr.beta_2_8_mass(tr.bin_edges(0.0, 1.0, 20)))}])::DOUBLE AS mass),
bs AS (SELECT {_bin_sql("risk_score", _edges_sql())} AS bin, count(*) AS c FROM spans GROUP BY 1),
bc AS (SELECT mass * (SELECT greatest(count(*), 500) FROM spans) AS p, coalesce(c, 0)::DOUBLE AS q FROM be LEFT JOIN bs USING (bin)),
shift AS (SELECT least(greatest({_kl_sql("bc")} / 2.0, 0.0), 1.0) AS s)"""


@query("T-1", "spans", f"""
SELECT agent_id, {r("avg(risk_score)", 4)} AS mean, {r("stddev_pop(risk_score)", 4)} AS std, {r("quantile_cont(risk_score, 0.95)", 4)} AS p95,
  {r("quantile_cont(risk_score, 0.99)", 4)} AS p99 FROM spans GROUP BY agent_id
UNION ALL SELECT -1, {r("avg(risk_score)", 4)}, {r("stddev_pop(risk_score)", 4)}, {r("quantile_cont(risk_score, 0.95)", 4)}, {r("quantile_cont(risk_score, 0.99)", 4)} FROM spans""")
def trace_risk_stats(spans: DataFrame) -> DataFrame:
    return tr.risk_stats(spans, ["agent_id"]).unionByName(tr.risk_stats(spans).withColumn("agent_id", F.lit(-1).cast("bigint")))


@query("T-2 T-3 T-4 T-5 T-7 T-8", "spans", f"WITH {_ANN} SELECT span_id, types AS anomaly_types, is_anomalous FROM ann")
def trace_annotations(spans: DataFrame) -> DataFrame:
    return tr.annotate_spans(spans).select("span_id", F.array_join("anomaly_types", ",").alias("anomaly_types"), "is_anomalous")


@query("T-6", "spans", f"WITH {_BETA} SELECT {r('s')} AS shift_score FROM shift")
def trace_shift_vs_clean(spans: DataFrame) -> DataFrame:
    return tr.shift_vs_beta(spans).select(round_to("shift_score", 6).alias("shift_score"))


@query("T-9", "spans", f"""
WITH {_ANN}, e AS (SELECT unnest(string_split(types, ',')) AS t FROM ann),
k AS (SELECT unnest(['prompt_risk_spike','tool_denial_surge','latency_anomaly','distribution_shift','memory_corruption','retrieval_hijack','multi_agent_collusion','reward_hacking']) AS t)
SELECT k.t AS anomaly_type, count(e.t) AS spans FROM k LEFT JOIN e ON e.t = k.t GROUP BY k.t""")
def trace_anomaly_breakdown(spans: DataFrame) -> DataFrame:
    return tr.anomaly_breakdown(tr.annotate_spans(spans))


@query("T-10", "spans", f"WITH {_ROOT} SELECT * FROM root")
def trace_root_cause(spans: DataFrame) -> DataFrame:
    return tr.root_cause(spans)


@query("T-10", "spans", f"""
WITH {_ROOT} SELECT b.trace_id, root_span_id, b.span_id, {r("b.risk_score")} AS risk_score FROM root JOIN o a ON a.span_id = root_span_id
JOIN o b ON b.trace_id = a.trace_id AND b.k > a.k AND b.risk_score >= 0.4 WHERE is_propagating""")
def trace_propagation(spans: DataFrame) -> DataFrame:
    out = tr.propagation_path(spans, tr.root_cause(spans))
    return out.select("trace_id", "root_span_id", "span_id", round_to("risk_score", 6).alias("risk_score"))


@query("T-11", "spans", f"""
WITH {_ANN}, {_BETA},
t AS (SELECT count(*) AS n, count_if(bad) AS b FROM (SELECT trace_id, bool_or(is_anomalous) AS bad FROM ann GROUP BY trace_id)),
s AS (SELECT count(*) AS n, avg(duration_ms) AS a, quantile_cont(duration_ms, 0.99) AS q, {r("quantile_cont(risk_score, 0.95)", 4)} AS p95 FROM spans),
k AS (SELECT t.n AS tn, t.b, s.n AS sn, a, q, rate, shift.s AS sh, least(greatest(CAST(0.40 AS DOUBLE) * (t.b / t.n) + CAST(0.25 AS DOUBLE) * least(shift.s, 1.0)
  + CAST(0.20 AS DOUBLE) * least(p95 / 0.65, 1.0) + CAST(0.15 AS DOUBLE) * least(rate / 0.15, 1.0), 0.0), 1.0) AS risk FROM t, s, den, shift)
SELECT tn AS total_traces, sn AS total_spans, b AS anomalous_traces, {r("rate", 4)} AS tool_denial_rate, {r("a", 3)} AS avg_latency_ms, {r("q", 3)} AS latency_p99_ms,
  {r("sh", 4)} AS distribution_shift_score, {r("risk", 4)} AS risk_score, CASE WHEN risk < 0.25 THEN 'clean' WHEN risk < 0.55 THEN 'suspicious' ELSE 'poisoned' END AS verdict FROM k""")
def trace_dataset_risk(spans: DataFrame) -> DataFrame:
    return tr.dataset_risk(tr.annotate_spans(spans))


_HALF = "TIMESTAMP '2024-01-12'"
_LAT_EDGES = "(SELECT list(CASE WHEN i = 20 THEN hi ELSE i * (hi / 20) END ORDER BY i) FROM (SELECT ln(1 + max(ln(1 + duration_ms)) + 1) AS hi FROM spans), range(21) x(i))"


@query("T-12", "spans", f"""
WITH s AS (SELECT *, CASE WHEN ts < {_HALF} THEN 0 ELSE 1 END AS side FROM spans),
le AS (SELECT {_LAT_EDGES} AS e),
rb AS (SELECT {_bin_sql("risk_score", _edges_sql())} AS bin, count_if(side = 0) AS p, count_if(side = 1) AS q FROM s GROUP BY 1),
lb AS (SELECT {_bin_sql("ln(1 + duration_ms)", "e")} AS bin, count_if(side = 0) AS p, count_if(side = 1) AS q FROM s, le GROUP BY 1),
b20 AS (SELECT unnest(range(0, 20)) AS bin),
rc AS (SELECT coalesce(p, 0) AS p, coalesce(q, 0) AS q FROM b20 LEFT JOIN rb USING (bin)),
lc AS (SELECT coalesce(p, 0) AS p, coalesce(q, 0) AS q FROM b20 LEFT JOIN lb USING (bin)),
tc AS (SELECT tool_name, count_if(side = 0) AS p, count_if(side = 1) AS q FROM s WHERE event_type = 'tool_call' GROUP BY 1),
ac AS (SELECT agent_id, count_if(side = 0) AS p, count_if(side = 1) AS q FROM s GROUP BY 1),
k AS (SELECT {_kl_sql("rc")} AS a, {_kl_sql("lc")} AS b, {_kl_sql("tc")} AS c, {_kl_sql("ac")} AS d),
o AS (SELECT *, CAST(0.35 AS DOUBLE) * least(greatest(a / 2, 0), 1) + CAST(0.30 AS DOUBLE) * least(greatest(b / 2, 0), 1) + CAST(0.20 AS DOUBLE) * least(greatest(c / 2, 0), 1) + CAST(0.15 AS DOUBLE) * least(greatest(d / 2, 0), 1) AS s FROM k)
SELECT {r("a")} AS risk_score_kl, {r("b")} AS latency_kl, {r("c")} AS tool_frequency_kl, {r("d")} AS agent_activity_kl, {r("s", 4)} AS overall_shift_score,
  CASE WHEN s < 0.2 THEN 'stable' WHEN s < 0.5 THEN 'drifting' ELSE 'shifted' END AS verdict FROM o""")
def trace_distribution_shift(spans: DataFrame) -> DataFrame:
    middle = F.lit("2024-01-12").cast("timestamp")
    return tr.distribution_shift(spans.where(F.col("ts") < middle), spans.where(F.col("ts") >= middle))


@query("T-13", "spans", f"""
WITH {_ANN} SELECT strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, trace_id, span_id, agent_id, event_type, {r("duration_ms", 3)} AS duration_ms, {r("risk_score", 4)} AS risk_score,
  is_anomalous, types AS anomaly_types, CASE WHEN event_type = 'tool_call' THEN tool_name END AS tool_name FROM ann""")
def trace_timeline(spans: DataFrame) -> DataFrame:
    out = tr.timeline(tr.annotate_spans(spans)).drop("doc_id")
    return out.withColumns({"ts": F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), "anomaly_types": F.array_join("anomaly_types", ",")})


@query("T-14", "spans", f"""
WITH {_ANN}, gg AS (SELECT count(DISTINCT trace_id) AS t, count(*) AS n, count_if(is_anomalous) AS a, avg(risk_score) AS m, stddev_pop(risk_score) AS sd,
  count_if(event_type = 'tool_call' AND risk_score > 0.5) / count_if(event_type = 'tool_call') AS d, avg(duration_ms) AS lm,
  quantile_disc(risk_score, 0.95) AS r95, quantile_disc(risk_score, 0.99) AS r99, quantile_disc(duration_ms, 0.95) AS l95, quantile_disc(duration_ms, 0.99) AS l99 FROM ann)
SELECT t AS total_traces, n AS total_spans, a AS anomalous_spans, {r("m", 4)} AS risk_mean, {r("sd", 4)} AS risk_std, {r("d", 4)} AS tool_denial_rate, {r("lm", 1)} AS latency_mean,
  {r("r95", 4)} AS risk_p95, {r("r99", 4)} AS risk_p99, l95 AS latency_p95, l99 AS latency_p99, {r("a / n", 4)} AS anomalous_rate,
  CASE WHEN a / n < 0.05 THEN 'clean' WHEN a / n < 0.15 THEN 'suspicious' ELSE 'poisoned' END AS verdict FROM gg""")
def trace_report_edge(spans: DataFrame) -> DataFrame:
    return tr.span_report_edge(tr.annotate_spans(spans))


@query("T-14", "spans", f"""
WITH {_ANN}, e AS (SELECT unnest(string_split(types, ',')) AS flag FROM ann WHERE types <> '')
SELECT flag, count(*) AS count FROM e GROUP BY flag ORDER BY count DESC, flag LIMIT 10""")
def trace_top_flags(spans: DataFrame) -> DataFrame:
    return tr.top_flags(tr.annotate_spans(spans))


_TRACES = "t AS (SELECT trace_id, min(ts) AS ts, max(risk_score) AS risk, bool_or(is_anomalous) AS bad FROM ann GROUP BY trace_id)"


@query("T-15", "spans", f"""
WITH {_ANN}, {_TRACES}, s AS (SELECT min(epoch_ms(ts)) AS lo, greatest((max(epoch_ms(ts)) - min(epoch_ms(ts))) / 40.0, 1.0)::DOUBLE AS w FROM t),
b AS (SELECT floor((epoch_ms(ts) - lo) / w) AS bin, avg(risk) AS a, count_if(bad) AS x, count_if(NOT bad) AS y FROM t, s GROUP BY 1)
SELECT k.bin, coalesce({r("a", 4)}, 0) AS avg_risk, coalesce(x, 0) AS anomalous_count, coalesce(y, 0) AS normal_count
FROM (SELECT unnest(range(0, 40)) AS bin) k LEFT JOIN b ON b.bin = k.bin""")
def trace_bucket_timeline(spans: DataFrame) -> DataFrame:
    return tr.bucket_timeline(tr.trace_summary(tr.annotate_spans(spans)))


@query("T-16", "spans", f"""
WITH {_ANN}, {_TRACES}, {_ROOT}
SELECT t.trace_id, {r("risk")} AS risk_score, root_span_id, confidence FROM t JOIN root USING (trace_id) WHERE bad AND root_span_id IS NOT NULL
ORDER BY risk DESC, t.trace_id LIMIT 25""")
def trace_ranked_root_causes(spans: DataFrame) -> DataFrame:
    return tr.rank_root_causes(tr.annotate_spans(spans)).withColumn("risk_score", round_to("risk_score", 6))
