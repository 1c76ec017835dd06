"""Streaming operators over several files and late rows."""

import datetime as dt

from pyspark.sql import functions as F

from sparkpoison.operators import ingest as ing
from sparkpoison.sources.streams import file_stream, run_available
from sparkpoison.streaming import dedup_ingest, stream_baselines, stream_collusion
from sparkpoison.streaming.detect import current_baselines, stream_auto_alert, stream_trend


def _write(spark, rows, schema, folder, n):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/f{n}")


def test_late_rows_are_dropped_and_closed_windows_emitted(spark, tmp_path):
    schema = "agent_id long, ts timestamp, is_anomalous boolean"
    t = dt.datetime(2024, 1, 1)
    early = [(a, t + dt.timedelta(seconds=a), True) for a in range(3)]
    # A batch filters late rows with the watermark known before the batch ahead of it ended.
    later = [(9, t + dt.timedelta(hours=2), True)]
    after = [(9, t + dt.timedelta(hours=3), True)]
    late = [(7, t + dt.timedelta(seconds=5), True)]
    last = [(9, t + dt.timedelta(hours=4), True)]
    for n, rows in enumerate((early, later, after, late, last)):
        _write(spark, rows, schema, str(tmp_path / "in"), n)
    stream = file_stream(spark, str(tmp_path / "in/*"), schema, max_files=1)
    out = run_available(stream_collusion(stream), "append", str(tmp_path / "run")).collect()
    assert [(r.start, r.agents) for r in out] == [(t, 3)]


def test_duplicates_across_files(spark, tmp_path):
    schema = "inference_id long, created_at timestamp"
    rows = [(i, dt.datetime(2024, 1, 1, 0, i)) for i in range(10)]
    for n in range(2):
        _write(spark, rows, schema, str(tmp_path / "in"), n)
    stream = file_stream(spark, str(tmp_path / "in/*"), schema, max_files=1)
    assert run_available(dedup_ingest(stream), path=str(tmp_path / "run")).count() == 10


def test_baselines_keep_the_latest(spark, tmp_path):
    schema = "application_id string, feature_name string, mean_value double, version long"
    for n in range(3):
        _write(spark, [("a", "f", float(n), n), (f"b{n}", "f", 1.0, 0)], schema, str(tmp_path / "in"), n)
    stream = file_stream(spark, str(tmp_path / "in/*"), schema, max_files=1)
    stream_baselines(stream, str(tmp_path / "run")).awaitTermination()
    got = {r.application_id: r.mean_value for r in current_baselines(spark, str(tmp_path / "run")).collect()}
    assert got == {"a": 2.0, "b0": 1.0, "b1": 1.0, "b2": 1.0}


def test_quarantine_and_coercion(spark):
    df = spark.createDataFrame([("1.5", ["1", "x"]), ("nan", ["1", "2"]), ("", None)], "v string, a array<string>")
    got = df.select(ing.to_float("v").alias("v"), ing.to_float_array("a").alias("a")).collect()
    assert [r.v for r in got] == [1.5, None, None] and [r.a for r in got] == [None, [1.0, 2.0], None]
    scans = spark.createDataFrame([("mcp_auditor", "clean", 0.5), ("x", "odd", 2.0)], "engine string, verdict string, risk_score double")
    ok, bad = ing.quarantine(scans, ing.scan_rules())
    assert ok.count() == 1 and bad.first().violations == ["engine", "verdict", "risk_score"]


def test_upsert_keeps_one_active_row(spark):
    old = spark.createDataFrame([("a", "f", 1.0, True), ("b", "f", 1.0, True)], "application_id string, feature_name string, mean_value double, is_active boolean")
    new = old.where("application_id = 'a'").withColumn("mean_value", F.lit(9.0))
    rows = ing.upsert_baselines(old, new).where("is_active").collect()
    assert sorted((r.application_id, r.mean_value) for r in rows) == [("a", 9.0), ("b", 1.0)]


def test_alerts_and_trends_over_several_files_with_text_ids(spark, tmp_path):
    schema = "tenant_id string, scan_id string, engine string, verdict string, risk_score double, created_at timestamp"
    t = dt.datetime(2024, 1, 1)
    for n, verdict in enumerate(("clean", "poisoned", "poisoned", "suspicious")):
        _write(spark, [("t", "s-1", "rag_detector", verdict, 0.1 * n, t + dt.timedelta(hours=n))], schema, str(tmp_path / "in"), n)
    stream = file_stream(spark, str(tmp_path / "in/*"), schema, max_files=1)
    assert run_available(stream_auto_alert(stream), path=str(tmp_path / "alerts")).count() == 2
    history = stream.select("tenant_id", F.concat("scan_id", F.col("created_at").cast("string")).alias("record_id"), F.col("created_at").alias("at"), F.col("risk_score").alias("score"))
    rows = run_available(stream_trend(history), path=str(tmp_path / "trend")).orderBy("record_id").collect()
    assert [r.trend for r in rows] == ["insufficient_data", "insufficient_data", "degrading", "degrading"]


def test_old_baseline_versions_go(spark, tmp_path):
    schema = "application_id string, feature_name string, mean_value double, version long"
    for n in range(4):
        _write(spark, [("a", "f", float(n), n)], schema, str(tmp_path / "in"), n)
    stream_baselines(file_stream(spark, str(tmp_path / "in/*"), schema, max_files=1), str(tmp_path / "run")).awaitTermination()
    assert sorted(p.name for p in (tmp_path / "run/table").iterdir() if p.name.startswith("batch")) == ["batch=2", "batch=3"]


def test_scans_share_groups_and_expire_alone(spark, tmp_path):
    """A few states hold all scans; a scan forgotten raises its verdict again, one that is renewed does not."""
    schema, t = "tenant_id long, scan_id long, engine string, verdict string, risk_score double, created_at timestamp", dt.datetime(2024, 1, 1)
    every = [(1, i, "rag_detector", "poisoned", 0.5, t) for i in range(30)]
    hour = lambda n, ids: [(1, i, "rag_detector", "poisoned", 0.5, t + dt.timedelta(hours=n)) for i in ids]
    for n, rows in enumerate((every, hour(11, [0]), hour(15, [99]), hour(16, [99]), hour(17, [0, 1]))):
        _write(spark, rows, schema, str(tmp_path / "in"), n)
    stream = file_stream(spark, str(tmp_path / "in/*"), schema, max_files=1)
    out = stream_auto_alert(stream, expiry=dt.timedelta(hours=12), delay="1 hour", groups=4)
    got = run_available(out, path=str(tmp_path / "alerts")).groupBy("scan_id").count().collect()
    assert {r.scan_id: r["count"] for r in got} == {**{i: 2 if i == 1 else 1 for i in range(30)}, 99: 1}
