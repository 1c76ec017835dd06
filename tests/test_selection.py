"""Percentiles and rank sums on values that a sketch or a fixed grid of buckets cannot part."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkpoison.functions.stats import image, percentiles
from sparkpoison.operators import evaluate, text


def test_image_keeps_the_order(spark):
    values = [0.0, -0.0, 1.5, -1.5, 5e-324, -5e-324, 1e308, -1e308, math.inf, -math.inf, math.nan, math.nextafter(1, 2), 1.0]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", image("v + 0.0D").alias("i")).collect()
    by_image = [r.v for r in sorted(rows, key=lambda r: r.i)]
    assert [str(x) for x in by_image[:-1]] == [str(x) for x in sorted((v + 0.0 for v in values if v == v))] or by_image[-1] != by_image[-1]
    kept = [x for x in by_image if x == x]
    assert kept == sorted(kept) and math.isnan(by_image[-1])


@pytest.mark.parametrize("method", ["linear", "nearest", "straddle"])
def test_percentiles_of_groups(spark, method):
    rng = random.Random(3)
    groups = {
        "near": [1.0 + i * 2.0**-52 for i in range(3000)], "same": [0.25] * 500, "one": [-7.0], None: [rng.uniform(-1, 1) for _ in range(1001)],
        "wide": [rng.choice((-1, 1)) * 10.0 ** rng.randint(-300, 300) for _ in range(700)] + [0.0, -0.0],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("near", None), ("none", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    probs = {"low": 0.0, "mid": 0.5, "p95": 0.95, "top": 1.0}
    got = {r.g: r for r in percentiles(df, "v", probs, ["g"], method).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        vs = sorted(v + 0.0 for v in vs)
        n = len(vs)
        for name, p in probs.items():
            if method == "linear":
                assert got[g][name] == pytest.approx(float(np.percentile(vs, 100 * p)), rel=1e-12), (g, name)
            elif method == "nearest":
                assert got[g][name] == vs[max(0, min(math.ceil(p * n) - 1, n - 1))]
            else:
                k = max(math.floor(p * n) - 1, 0)
                assert got[g][name] == vs[k] and got[g][f"{name}_next"] == (vs[k + 1] if k + 1 < n else None)


def test_no_task_orders_many_values(spark):
    n = 300_000
    df = spark.range(n).select((F.col("id") / F.lit(float(n))).alias("v"))
    got = percentiles(df, "v", {"m": 0.5, "p": 0.99}).first()
    assert got.m == pytest.approx(0.5 * (n - 1) / n) and got.p == pytest.approx(0.99 * (n - 1) / n)
    assert percentiles(df.limit(0), "v", {"m": 0.5}).collect() == [] or percentiles(df.limit(0), "v", {"m": 0.5}).first().m is None


def test_auc_of_scores_in_one_bucket_and_outside_the_unit_range(spark):
    rng = random.Random(8)
    rows = [("a", 0.5 + rng.randrange(200) * 2.0**-50, rng.randrange(2)) for _ in range(800)]
    rows += [("b", rng.choice([-3.5, -1e-9, 0.0, 2.0, 1e12]), rng.randrange(2)) for _ in range(300)] + [("c", 0.1, 1), ("c", None, 0)]
    df = spark.createDataFrame(rows, "dataset string, score double, label int").repartition(4)
    got = {r.dataset: r for r in evaluate.auc(df, ["dataset"]).collect()}
    for g in "ab":
        pos = [s for d, s, y in rows if d == g and y == 1]
        neg = [s for d, s, y in rows if d == g and y == 0]
        won = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg)
        assert got[g].auc == pytest.approx(won / len(pos) / len(neg), abs=1e-12)
        assert (got[g].positives, got[g].negatives) == (len(pos), len(neg))
    assert got["c"].auc is None


def test_shingles_of_a_long_document_take_linear_time(spark):
    words = 200_000
    doc = spark.range(1).select(F.lit(1).alias("doc_id"), F.expr(f"array_join(transform(sequence(1, {words}), i -> concat('w', i % 150000)), ' ')").alias("text"))
    assert text.shingles(doc).count() == 150_000
