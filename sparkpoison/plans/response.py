"""Correlation, remediation, proof and evaluation queries with their check SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sparkpoison.functions import catalogue as cat
from sparkpoison.functions.numeric import round_to
from sparkpoison.operators import correlate as co, evaluate as ev, proofs as pr, remediate as rm
from sparkpoison.plans.registry import query
from sparkpoison.plans.views import r

_ENGINES = ["rag_detector", "vector_analyzer", "mcp_auditor"]
_FMT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
_SQLFMT = "'%Y-%m-%d %H:%M:%S.%f'"


def _r6(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: round_to(n, 6) for n in names})


_STAGE = "CASE technique " + " ".join(f"WHEN '{t}' THEN '{s}'" for t, s in cat.KILL_CHAIN.items()) + " END"


@query("C-1 C-2", "findings scans", f"""
SELECT 'finding' AS origin, {_STAGE} AS stage, engine, count(*) AS events FROM findings GROUP BY ALL
UNION ALL SELECT 'scan', NULL, engine, count(*) FROM scans WHERE verdict = 'poisoned' GROUP BY ALL""")
def attack_timeline(findings: DataFrame, scans: DataFrame) -> DataFrame:
    bad = scans.where(F.col("verdict") == "poisoned").select(
        F.col("scan_id").alias("event_id"), "engine", F.col("created_at").alias("ts"), F.lit("scan").alias("origin"))
    line = co.unified_timeline(co.classify(findings).withColumn("origin", F.lit("finding")), bad)
    return line.groupBy("origin", "stage", "engine").agg(F.count("*").alias("events"))


_CLUSTERS = f"""
ev AS MATERIALIZED (SELECT *, {_STAGE} AS stage FROM findings),
nb AS MATERIALIZED (SELECT a.event_id AS i, b.event_id AS j FROM ev a JOIN ev b ON abs(epoch_us(a.ts) - epoch_us(b.ts)) < 300000000
  AND epoch_us(a.ts) // 300000000 BETWEEN epoch_us(b.ts) // 300000000 - 1 AND epoch_us(b.ts) // 300000000 + 1 AND (a.entity_id = b.entity_id OR a.stage = b.stage)),
w AS (SELECT event_id AS i, event_id AS j FROM ev UNION SELECT w.i, nb.j FROM w JOIN nb ON nb.i = w.j),
cp AS (SELECT i, min(j) AS cluster_id FROM w GROUP BY i),
cl AS (SELECT ev.*, cluster_id FROM ev JOIN cp ON cp.i = event_id WHERE cluster_id IN (SELECT cluster_id FROM cp GROUP BY 1 HAVING count(*) >= 2))"""


def _clustered(findings: DataFrame) -> DataFrame:
    return co.clusters(co.classify(findings), minutes=5)


@query("C-3", "findings", f"WITH RECURSIVE {_CLUSTERS} SELECT event_id, cluster_id FROM cl")
def attack_clusters(findings: DataFrame) -> DataFrame:
    return _clustered(findings).select("event_id", "cluster_id")


@query("C-4", "findings", f"""
WITH RECURSIVE {_CLUSTERS}
SELECT cluster_id, count(*) AS events, strftime(min(ts), {_SQLFMT}) AS first_seen, strftime(max(ts), {_SQLFMT}) AS last_seen, count(DISTINCT entity_id) AS entities,
  count(DISTINCT engine) AS engines, {r("(epoch_us(max(ts)) - epoch_us(min(ts))) / 60000000.0")} AS span_minutes, {", ".join(f"count_if(stage = '{s}') AS {s}" for s in cat.STAGES)}
FROM cl GROUP BY cluster_id""")
def attack_cluster_summary(findings: DataFrame) -> DataFrame:
    out = co.cluster_summary(_clustered(findings))
    return _r6(out, "span_minutes").withColumns({c: F.date_format(c, _FMT) for c in ("first_seen", "last_seen")})


@query("C-4", "findings", f"""
WITH RECURSIVE {_CLUSTERS} SELECT (SELECT count(*) FROM ev) AS total_events, count(*) AS correlated_events,
  (SELECT count(*) FROM ev) - count(*) AS uncorrelated_events, count(DISTINCT cluster_id) AS clusters FROM cl""")
def attack_totals(findings: DataFrame) -> DataFrame:
    return co.correlation_totals(findings, _clustered(findings))


_MATCH = """
ru AS (SELECT * FROM rules WHERE enabled QUALIFY row_number() OVER (PARTITION BY engine, severity ORDER BY priority) = 1),
ma AS (SELECT f.event_id, f.entity_id, f.ts, rule_id, action, mode, CASE WHEN mode = 'auto' THEN 'executed' ELSE 'pending' END AS status
  FROM findings f JOIN ru ON ru.engine = f.engine AND ru.severity = f.severity)"""


@query("X-1 X-2", "findings rules", f"WITH {_MATCH} SELECT event_id, rule_id, action, mode, status FROM ma")
def remediation_matches(findings: DataFrame, rules: DataFrame) -> DataFrame:
    return rm.match_rules(findings, rules).select("event_id", "rule_id", "action", "mode", "status")


@query("X-3", "findings rules documents", f"""
WITH {_MATCH}, lg AS (SELECT entity_id, CASE WHEN event_id % 3 = 0 THEN 'rolled_back' ELSE status END AS status, ts FROM ma WHERE action = 'quarantine'),
la AS (SELECT entity_id, arg_max(status, ts) AS s FROM lg GROUP BY entity_id)
SELECT doc_id AS entity_id, source FROM documents WHERE doc_id NOT IN (SELECT entity_id FROM la WHERE s = 'executed' AND entity_id IS NOT NULL)""")
def remediation_corpus(findings: DataFrame, rules: DataFrame, documents: DataFrame) -> DataFrame:
    rolled = F.when(F.col("event_id") % 3 == 0, "rolled_back").otherwise(F.col("status"))
    log = rm.match_rules(findings, rules).select("entity_id", "action", rolled.alias("status"), F.col("ts").alias("at"))
    return rm.apply_actions(documents.select(F.col("doc_id").alias("entity_id"), "source"), log)


_CHAIN = """
pl AS (SELECT tenant_id, idx, idx // 4096 AS segment, sha256(result) AS h, row_number() OVER (PARTITION BY tenant_id, idx // 4096 ORDER BY idx) AS k FROM proof_log),
ch AS (SELECT tenant_id, segment, idx, k, h, sha256(h) AS c FROM pl WHERE k = 1
  UNION ALL SELECT pl.tenant_id, pl.segment, pl.idx, pl.k, pl.h, sha256(ch.c || pl.h) FROM ch JOIN pl ON pl.tenant_id = ch.tenant_id AND pl.segment = ch.segment AND pl.k = ch.k + 1)"""


@query("H-1", "proof_log", f"WITH RECURSIVE {_CHAIN} SELECT tenant_id, idx, segment, h AS result_hash, c AS chain_hash FROM ch")
def proof_chain(proof_log: DataFrame) -> DataFrame:
    return pr.build_chain(proof_log)


@query("H-1", "proof_log", f"""
WITH RECURSIVE {_CHAIN},
hd AS (SELECT tenant_id, segment, head, row_number() OVER (PARTITION BY tenant_id ORDER BY segment) AS place, count(*) OVER (PARTITION BY tenant_id) AS heads
  FROM (SELECT tenant_id, segment, arg_max(c, idx) AS head FROM ch GROUP BY tenant_id, segment)),
up AS (SELECT tenant_id, place, heads, head, sha256(sha256(head)) AS top FROM hd WHERE place = 1
  UNION ALL SELECT hd.tenant_id, hd.place, hd.heads, hd.head, sha256(up.top || sha256(hd.head)) FROM up JOIN hd ON hd.tenant_id = up.tenant_id AND hd.place = up.place + 1)
SELECT tenant_id, CASE WHEN heads = 1 THEN head ELSE top END AS root_hash FROM up WHERE place = heads""")
def proof_roots(proof_log: DataFrame) -> DataFrame:
    return pr.chain_roots(pr.build_chain(proof_log))


@query("H-2", "proof_log", """
WITH t AS (SELECT tenant_id, idx, idx // 4096 AS segment, idx % 997 = 5 AS bad FROM proof_log),
v AS (SELECT *, bad OR coalesce(lag(bad) OVER (PARTITION BY tenant_id, segment ORDER BY idx), false) AS broken FROM t)
SELECT tenant_id, count(*) AS records, count_if(NOT broken) AS verified, count_if(broken) AS failed, min(CASE WHEN broken THEN idx END) AS invalid_at FROM v GROUP BY tenant_id""")
def proof_verification(proof_log: DataFrame) -> DataFrame:
    chain = pr.build_chain(proof_log)
    forged = F.when(F.col("idx") % 997 == 5, F.sha2(F.col("chain_hash"), 256)).otherwise(F.col("chain_hash"))
    return pr.verify_chain(chain.withColumn("chain_hash", forged))


def _conf(by: str) -> str:
    return f"""(SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall,
  CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1, (tp + tn) / (tp + fp + tn + fn) AS accuracy, CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END AS fpr
  FROM (SELECT {by}, count_if(score >= 0.5 AND label = 1) AS tp, count_if(score >= 0.5 AND label <> 1) AS fp, count_if(score < 0.5 AND label <> 1) AS tn, count_if(score < 0.5 AND label = 1) AS fn
        FROM predictions GROUP BY {by}))"""


_DET = "dataset, engine, technique"


@query("E-1", "predictions", f"SELECT {_DET}, tp, fp, tn, fn, {', '.join(f'{r(c)} AS {c}' for c in ev.RATES)} FROM {_conf(_DET)}")
def eval_confusion(predictions: DataFrame) -> DataFrame:
    return _r6(ev.confusion(predictions), *ev.RATES)


@query("E-2", "predictions", f"""
WITH p AS (SELECT dataset, engine, a.score AS sp, b.sn FROM (SELECT * FROM predictions WHERE label = 1) a JOIN (SELECT dataset, engine, score AS sn FROM predictions WHERE label <> 1) b USING (dataset, engine)),
u AS (SELECT dataset, engine, avg(CASE WHEN sp > sn THEN 1.0 WHEN sp = sn THEN 0.5 ELSE 0.0 END) AS auc FROM p GROUP BY ALL),
n AS (SELECT dataset, engine, count_if(label = 1) AS positives, count_if(label <> 1) AS negatives FROM predictions GROUP BY ALL)
SELECT dataset, engine, positives, negatives, {r("auc")} AS auc FROM n LEFT JOIN u USING (dataset, engine)""")
def eval_auc(predictions: DataFrame) -> DataFrame:
    return _r6(ev.auc(predictions), "auc")


@query("E-3", "predictions", f"""
WITH m AS (SELECT engine, {r("avg(f1)", 4)} AS avg_f1, {r("avg(recall)", 4)} AS avg_recall FROM {_conf(_DET)} GROUP BY engine)
SELECT *, row_number() OVER (ORDER BY avg_f1 DESC, engine) AS rank FROM m""")
def eval_rankings(predictions: DataFrame) -> DataFrame:
    return ev.rankings(ev.confusion(predictions))


@query("E-3", "predictions", f"""
WITH p AS (SELECT technique, engine, avg(f1) AS f1 FROM {_conf(_DET)} GROUP BY ALL)
SELECT technique, {r("max(f1)")} AS best_f1, arg_min(engine, {{'a': f1, 'b': engine}}) AS worst_engine FROM p GROUP BY technique HAVING max(f1) < 0.85""")
def eval_technique_gaps(predictions: DataFrame) -> DataFrame:
    return _r6(ev.technique_gaps(ev.confusion(predictions)), "best_f1")


@query("E-3", "predictions", f"SELECT {r('avg(recall)')} AS mean_detection_rate, {r('avg(fpr)')} AS mean_fpr, {r('avg(f1)')} AS mean_f1 FROM {_conf(_DET)}")
def eval_means(predictions: DataFrame) -> DataFrame:
    return _r6(ev.overall_means(ev.confusion(predictions)), "mean_detection_rate", "mean_fpr", "mean_f1")


@query("E-4", "predictions", f"""
SELECT engine, technique, {", ".join(f"CAST(floor(avg({c}) + 0.5) AS BIGINT) AS {c}" for c in ("tp", "fp", "tn", "fn"))}, {", ".join(f"{r(f'avg({c})', 4)} AS {c}" for c in ev.RATES)}
FROM {_conf(_DET)} GROUP BY engine, technique""")
def eval_collapse(predictions: DataFrame) -> DataFrame:
    return ev.collapse(ev.confusion(predictions))


_MATRIX = f"""
cv AS (SELECT technique, {", ".join(f"coalesce(avg(CASE WHEN engine = '{e}' THEN recall END), 0) AS {e}" for e in _ENGINES)} FROM {_conf(_DET)} GROUP BY technique),
cm AS (SELECT *, greatest({", ".join(_ENGINES)}) AS combined FROM cv)"""


@query("E-5", "predictions", f"WITH {_MATRIX} SELECT technique, {', '.join(f'{r(e)} AS {e}' for e in _ENGINES)}, {r('combined')} AS combined, combined < 0.5 AS is_gap FROM cm")
def eval_coverage(predictions: DataFrame) -> DataFrame:
    return _r6(ev.coverage(ev.confusion(predictions), _ENGINES), *_ENGINES, "combined")


@query("E-5", "predictions", f"WITH {_MATRIX} SELECT {r('avg(combined)')} AS overall, {', '.join(f'{r(f"avg({e})")} AS {e}' for e in _ENGINES)} FROM cm")
def eval_platform_coverage(predictions: DataFrame) -> DataFrame:
    return _r6(ev.platform_coverage(ev.coverage(ev.confusion(predictions), _ENGINES), _ENGINES), "overall", *_ENGINES)


@query("E-6", "scans", f"""
WITH ro AS (SELECT engine AS session_id, CAST(created_at AS DATE) - DATE '2024-01-01' AS round, avg(CASE WHEN verdict <> 'clean' THEN 1.0 ELSE 0.0 END) AS dr FROM scans GROUP BY ALL),
d AS (SELECT *, abs(dr - lag(dr) OVER (PARTITION BY session_id ORDER BY round)) AS delta FROM ro),
s AS (SELECT *, coalesce(delta < 0.02, false) AS small FROM d),
b AS (SELECT *, sum(CASE WHEN small THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY round) AS brk FROM s),
n AS (SELECT *, sum(CASE WHEN small THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, brk ORDER BY round) AS run FROM b)
SELECT session_id, round, {r("dr")} AS detection_rate, {r("delta")} AS delta, run, run >= 3 AS is_converged FROM n""")
def eval_convergence(scans: DataFrame) -> DataFrame:
    rounds = scans.groupBy(F.col("engine").alias("session_id"), F.datediff("created_at", F.lit("2024-01-01")).alias("round")).agg(
        F.avg(F.when(F.col("verdict") != "clean", 1.0).otherwise(0.0)).alias("detection_rate"))
    return _r6(ev.convergence(rounds, threshold=0.02), "detection_rate", "delta")


@query("E-7", "predictions", f"SELECT engine, {r('avg(latency_ms)')} AS avg_latency_ms, {r('quantile_cont(latency_ms, 0.95)')} AS p95_latency_ms FROM predictions GROUP BY engine")
def eval_latency(predictions: DataFrame) -> DataFrame:
    return _r6(ev.latency(predictions), "avg_latency_ms", "p95_latency_ms")


@query("E-8", "predictions", f"""
WITH m AS (SELECT technique, {", ".join(f"coalesce(avg(CASE WHEN engine = '{e}' THEN recall END), 0) AS {e}" for e in _ENGINES)} FROM {_conf("technique, engine")} GROUP BY technique),
w AS (SELECT technique, count_if(score >= 0.5 AND label <> 1) / count_if(label <> 1) AS fpr, count(*) AS sample_size FROM predictions GROUP BY technique)
SELECT technique, {', '.join(f'{r(e)} AS {e}' for e in _ENGINES)}, {r(f"greatest({', '.join(_ENGINES)})")} AS combined, {r("fpr")} AS fpr, sample_size FROM m JOIN w USING (technique)""")
def eval_bounds(predictions: DataFrame) -> DataFrame:
    return _r6(ev.bounds(predictions, _ENGINES), *_ENGINES, "combined", "fpr")


@query("E-9", "predictions", f"""
WITH f AS (SELECT *, doc_id % 5 AS fold FROM predictions),
k AS {_conf("engine, fold").replace("FROM predictions", "FROM f")},
s AS (SELECT engine, avg(f1) AS m, CAST(1.96 AS DOUBLE) * stddev_samp(f1) / sqrt(count(*)) AS h FROM k GROUP BY engine)
SELECT engine, {r("m")} AS mean_f1, {r("m - h")} AS low, {r("m + h")} AS high FROM s""")
def eval_kfold(predictions: DataFrame) -> DataFrame:
    return _r6(ev.kfold(predictions), "mean_f1", "low", "high")


@query("E-10", "predictions", f"""
SELECT engine, {", ".join(f"CAST(floor(avg({c}) + 0.5) AS BIGINT) AS {c}" for c in ("tp", "fp", "tn", "fn"))}, {", ".join(f"{r(f'avg({c})')} AS {c}" for c in ("precision", "recall", "f1"))}
FROM {_conf(_DET)} WHERE dataset = 'en' GROUP BY engine""")
def eval_engine_confusion(predictions: DataFrame) -> DataFrame:
    return _r6(ev.engine_confusion(ev.confusion(predictions), "en"), "precision", "recall", "f1")


@query("E-10", "predictions", f"""
WITH n AS (SELECT technique, count(*) AS samples FROM predictions GROUP BY technique),
p AS (SELECT technique, engine, avg(recall) AS rate FROM {_conf(_DET)} GROUP BY ALL HAVING avg(recall) < 0.5)
SELECT technique, engine, {r("rate")} AS rate, samples FROM p JOIN n USING (technique)""")
def eval_uncovered(predictions: DataFrame) -> DataFrame:
    prevalence = predictions.groupBy("technique").agg(F.count("*").alias("samples"))
    return _r6(ev.uncovered(ev.confusion(predictions), prevalence), "rate")
