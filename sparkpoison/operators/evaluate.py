"""Evaluating detectors against labels: ``predictions(doc_id, dataset, engine, technique, label, score, latency_ms)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkpoison.functions.numeric import round_to, share
from sparkpoison.functions.stats import DIGIT, image, percentiles

RATES = ["precision", "recall", "f1", "accuracy", "fpr"]


def _counts(threshold: float) -> list[Column]:
    said, was = F.col("score") >= threshold, F.col("label") == 1
    return [
        F.count_if(said & was).alias("tp"), F.count_if(said & ~was).alias("fp"),
        F.count_if(~said & ~was).alias("tn"), F.count_if(~said & was).alias("fn"),
    ]


def _rates(df: DataFrame) -> DataFrame:
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return df.withColumns({
        "precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "f1": share(2 * tp, 2 * tp + fp + fn),
        "accuracy": share(tp + tn, tp + fp + tn + fn), "fpr": share(fp, fp + tn),
    })


def confusion(predictions: DataFrame, by: Sequence[str] = ("dataset", "engine", "technique"), threshold: float = 0.5) -> DataFrame:
    return _rates(predictions.groupBy(*by).agg(*_counts(threshold)))


def auc(predictions: DataFrame, by: Sequence[str] = ("dataset", "engine")) -> DataFrame:
    """Area under the ROC curve: the share of (positive, negative) pairs in order, ties half.

    Scores are counted per distinct value, and the values are the leaves of a trie over the 64 bits of their images, 16 bits
    a level. A pair is won at the node where its two scores part, so each level adds positives times negatives of smaller
    digits under the same prefix: no order is ever longer than 65536 counts, whatever the scores. Null scores are left out.
    """
    by = list(by)
    src = predictions.where(F.col("score").isNotNull()).withColumn("score", F.col("score").cast("double") + F.lit(0.0))
    counts = src.groupBy(*by, "score").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") != 1).alias("neg"))
    level = counts.select(*by, "pos", "neg", image("score").alias("_q"))
    won = counts.select(*by, "pos", "neg", (F.lit(0.5) * F.col("pos") * F.col("neg")).alias("_won"))
    for digit in range(64 // DIGIT):
        above = F.shiftright("_q", DIGIT) if digit < 64 // DIGIT - 1 else F.lit(0).cast("bigint")
        level = level.withColumn("_p", above)
        smaller = Window.partitionBy(*by, "_p").orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)
        beaten = F.col("pos") * F.coalesce(F.sum("neg").over(smaller), F.lit(0))
        zero = F.lit(0).cast("bigint")
        won = won.unionByName(level.select(*by, zero.alias("pos"), zero.alias("neg"), beaten.cast("double").alias("_won")))
        level = level.groupBy(*by, F.col("_p").alias("_q")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    out = won.groupBy(*by).agg(F.sum("_won").alias("_won"), F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))
    pairs = F.col("positives") * F.col("negatives")
    return out.select(*by, "positives", "negatives", F.when(pairs > 0, F.col("_won") / pairs).alias("auc"))


def latency(predictions: DataFrame, by: Sequence[str] = ("engine",)) -> DataFrame:
    mean = predictions.groupBy(*by).agg(F.avg("latency_ms").alias("avg_latency_ms"))
    return mean.join(percentiles(predictions, "latency_ms", {"p95_latency_ms": 0.95}, by), list(by))


def rankings(results: DataFrame) -> DataFrame:
    """Engines by mean F1; ``results`` are confusion rows."""
    means = results.groupBy("engine").agg(round_to(F.avg("f1"), 4).alias("avg_f1"), round_to(F.avg("recall"), 4).alias("avg_recall"))
    return means.withColumn("rank", F.row_number().over(Window.orderBy(F.col("avg_f1").desc(), "engine")))


def technique_gaps(results: DataFrame, enough: float = 0.85) -> DataFrame:
    """Techniques no engine detects well: best F1 and the worst engine."""
    per = results.groupBy("technique", "engine").agg(F.avg("f1").alias("f1"))
    out = per.groupBy("technique").agg(
        F.max("f1").alias("best_f1"), F.min_by("engine", F.struct("f1", "engine")).alias("worst_engine")
    )
    return out.where(F.col("best_f1") < enough)


def overall_means(results: DataFrame) -> DataFrame:
    return results.agg(
        F.avg("recall").alias("mean_detection_rate"), F.avg("fpr").alias("mean_fpr"), F.avg("f1").alias("mean_f1")
    )


def collapse(results: DataFrame) -> DataFrame:
    """Mean over datasets per engine and technique; counts are rounded to whole numbers."""
    return results.groupBy("engine", "technique").agg(
        *[F.floor(F.avg(c) + 0.5).cast("bigint").alias(c) for c in ("tp", "fp", "tn", "fn")],
        *[round_to(F.avg(c), 4).alias(c) for c in RATES],
    )


def engine_confusion(results: DataFrame, dataset: str | None = None) -> DataFrame:
    """Mean confusion matrix per engine, optionally of one dataset."""
    if dataset is not None:
        results = results.where(F.col("dataset") == dataset)
    return results.groupBy("engine").agg(
        *[F.floor(F.avg(c) + 0.5).cast("bigint").alias(c) for c in ("tp", "fp", "tn", "fn")],
        *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")],
    )


def coverage(results: DataFrame, engines: Sequence[str], gap: float = 0.50) -> DataFrame:
    """Detection rate per technique and engine as a matrix, with the combined (best) rate and gaps."""
    rates = results.groupBy("technique").pivot("engine", list(engines)).agg(F.avg("recall")).na.fill(0.0)
    best = F.greatest(*[F.col(e) for e in engines]) if len(engines) > 1 else F.col(engines[0])
    return rates.withColumn("combined", best).withColumn("is_gap", F.col("combined") < gap)


def platform_coverage(matrix: DataFrame, engines: Sequence[str]) -> DataFrame:
    return matrix.agg(F.avg("combined").alias("overall"), *[F.avg(e).alias(e) for e in engines])


def uncovered(results: DataFrame, prevalence: DataFrame, gap: float = 0.50) -> DataFrame:
    """Technique-engine pairs under the gap rate, most prevalent technique first."""
    pairs = results.groupBy("technique", "engine").agg(F.avg("recall").alias("rate")).where(F.col("rate") < gap)
    return pairs.join(prevalence, "technique").orderBy(F.col("samples").desc(), "technique", "engine")


def bounds(predictions: DataFrame, engines: Sequence[str], at: str | None = None) -> DataFrame:
    """Detection bounds per technique: rate per engine, combined rate, false positives, samples, latest time."""
    per = confusion(predictions, ["technique", "engine"])
    matrix = coverage(per, engines).drop("is_gap")
    extra = [F.max(at).alias("last_updated")] if at else []
    whole = predictions.groupBy("technique").agg(*_counts(0.5), F.count("*").alias("sample_size"), *extra)
    keep = ["technique", "fpr", "sample_size"] + (["last_updated"] if at else [])
    return matrix.join(_rates(whole).select(*keep), "technique")


def kfold(predictions: DataFrame, by: Sequence[str] = ("engine",), folds: int = 5) -> DataFrame:
    """Mean F1 over folds (id modulo ``folds``) with its 95 % confidence interval."""
    per = confusion(predictions.withColumn("fold", F.pmod("doc_id", F.lit(folds))), [*by, "fold"])
    mean, half = F.avg("f1"), 1.96 * F.stddev_samp("f1") / F.sqrt(F.count("*"))
    return per.groupBy(*by).agg(mean.alias("mean_f1"), (mean - half).alias("low"), (mean + half).alias("high"))


def convergence(rounds: DataFrame, threshold: float = 0.01, needed: int = 3) -> DataFrame:
    """Per session of ``rounds(session_id, round, detection_rate)`` each round's change, run length and convergence."""
    w = Window.partitionBy("session_id").orderBy("round")
    delta = F.abs(F.col("detection_rate") - F.lag("detection_rate").over(w))
    steps = rounds.withColumn("delta", delta).withColumn("_small", F.coalesce(F.col("delta") < threshold, F.lit(False)))
    steps = steps.withColumn("_break", F.sum(F.when(F.col("_small"), 0).otherwise(1)).over(w))
    run = Window.partitionBy("session_id", "_break").orderBy("round")
    length = F.sum(F.when(F.col("_small"), 1).otherwise(0)).over(run)
    return steps.withColumn("run", length).withColumn("is_converged", F.col("run") >= needed).drop("_small", "_break")
