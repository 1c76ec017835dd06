"""Embedding integrity: centroids, dispersion, outliers and batch reports.

Everything per batch is an aggregate that combines before the shuffle; per-batch rows are
brought back to the vectors by a broadcast whose size is checked, so a batch holding most
of the rows never has to be shuffled to one place.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from sparkpoison.functions.numeric import banded, cap1, clip01
from sparkpoison.functions.stats import percentiles
from sparkpoison.functions.vector import cosine, dot, norm
from sparkpoison.session import broadcast_if_small, checkpoint

SIMILARITY_FLOOR = 0.85
SIGMA = 3.0
MIN_BASELINE = 100


def _partials(vecs: DataFrame, by: Sequence[str], kernel, name: str) -> DataFrame:
    """One row per task and group: the kernel's flat array summed over the task's rows."""
    by = list(by)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        totals: dict[tuple, list] = {}

        def flush() -> pa.RecordBatch:
            keys = list(totals)
            columns = [pa.array([k[i] for k in keys], t) for i, t in enumerate(types)]
            columns.append(pa.array([totals[k][0] for k in keys], pa.int64()))
            columns.append(pa.array([totals[k][1] for k in keys], pa.list_(pa.float64())))
            totals.clear()
            return pa.RecordBatch.from_arrays(columns, [*by, "n", name])

        for batch in batches:
            types = [batch.column(i).type for i in range(len(by))]
            vectors = batch.column(len(by))
            lengths = np.diff(vectors.offsets.to_numpy())
            keys = list(zip(*[batch.column(i).to_pylist() for i in range(len(by))], lengths.tolist()))
            rows: dict[tuple, list[int]] = {}
            for i, key in enumerate(keys):
                rows.setdefault(key, []).append(i)
            for key, at in rows.items():
                flat = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
                part = kernel(flat.astype(np.float64).reshape(len(at), key[-1]))
                held = totals.setdefault(key, [0, 0.0])
                held[0] += len(at)
                held[1] = held[1] + part
            if sum(v[1].nbytes for v in totals.values()) > 64_000_000:
                yield flush()
        if totals:
            yield flush()

    types = dict(vecs.dtypes)
    ddl = ", ".join([f"{k} {types[k]}" for k in by] + ["n bigint", f"{name} array<double>"])
    return (
        vecs.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0))
        .select(*by, "embedding").mapInArrow(scan, ddl)
    )


def centroid(vecs: DataFrame, by: Sequence[str] = ("batch_id",)) -> DataFrame:
    """Component means per group: (by…, n, centroid)."""
    parts = _partials(vecs, by, lambda m: m.sum(axis=0), "sums")
    cells = parts.select(*by, "n", F.posexplode("sums").alias("pos", "s")).groupBy(*by, "pos").agg(
        F.sum("s").alias("s"), F.sum("n").alias("n")
    )
    ordered = F.array_sort(F.collect_list(F.struct("pos", (F.col("s") / F.col("n")).alias("c"))))
    return cells.groupBy(*by).agg(F.max("n").alias("n"), F.transform(ordered, lambda x: x["c"]).alias("centroid"))


def sim_to_centroid(vecs: DataFrame, centroids: DataFrame, floor: float | None = None) -> DataFrame:
    """Adds ``similarity`` to the batch centroid."""
    mids = broadcast_if_small(checkpoint(centroids.select("batch_id", "centroid")))
    return vecs.join(mids, "batch_id").withColumn(
        "similarity", cosine("embedding", "centroid", floor)
    ).drop("centroid")


def dispersion_rate(vecs: DataFrame, by: Sequence[str] = ("batch_id",)) -> DataFrame:
    """Population standard deviation of all pairwise cosine similarities, without forming a pair.

    With unit vectors u, s = Σu and G = Σuuᵀ, the similarities of all pairs sum to
    (|s|² - n)/2 and their squares to (‖G‖²_F - n)/2. G is accumulated per task as a matrix
    product; vectors wider than 1024 are handled in slabs of G's rows so a task holds one slab.
    """
    by = list(by)

    def unit(m: np.ndarray) -> np.ndarray:
        norms = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(norms > 0, norms, 1.0)

    def kernel(m: np.ndarray) -> np.ndarray:
        u = unit(m)
        return np.concatenate([u.sum(axis=0), (u.T @ u).ravel()])

    parts = _partials(vecs, by, kernel, "cells")
    # |cells| = d + d², so d is recovered from the array's own length.
    width = F.floor((F.sqrt(1.0 + 4.0 * F.size("cells")) - 1.0) / 2.0 + 0.5).cast("int")
    cells = (
        parts.select(*by, "n", width.alias("d"), F.posexplode("cells").alias("pos", "v"))
        .groupBy(*by, "d", "pos").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    )
    n = F.max("n")
    sums = cells.groupBy(*by).agg(
        n.alias("n"),
        F.sum(F.when(F.col("pos") < F.col("d"), F.col("v") * F.col("v")).otherwise(0.0)).alias("s2"),
        F.sum(F.when(F.col("pos") >= F.col("d"), F.col("v") * F.col("v")).otherwise(0.0)).alias("g2"),
    )
    pairs = F.col("n") * (F.col("n") - 1) / 2.0
    mean = (F.col("s2") - F.col("n")) / 2.0 / pairs
    square = (F.col("g2") - F.col("n")) / 2.0 / pairs
    rate = F.when(F.col("n") < 2, 0.0).otherwise(F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))))
    return sums.select(*by, F.col("n").alias("vectors"), rate.alias("dispersion_rate"))


def check_dims(vecs: DataFrame, smallest: int = 64, largest: int = 8192, most: int | None = 50_000) -> DataFrame:
    """Per batch: vector count, dimension range and the rules it breaks.

    ``most`` vectors make a submission; None for stored batches, which have no such limit.
    """
    size = F.size("embedding")
    rules = F.array_compact(
        F.array(
            F.when(F.col("dim_min") != F.col("dim_max"), "mixed_dimensions"),
            F.when(F.col("dim_min") < smallest, "dimension_too_small"),
            F.when(F.col("dim_max") > largest, "dimension_too_large"),
            F.when(F.lit(most is not None) & (F.col("vectors") > F.lit(most)), "too_many_vectors"),
        )
    )
    return (
        vecs.groupBy("batch_id")
        .agg(F.count("*").alias("vectors"), F.min(size).cast("bigint").alias("dim_min"), F.max(size).cast("bigint").alias("dim_max"))
        .withColumn("violations", rules).withColumn("is_valid", F.size("violations") == 0)
    )


def zscore_outliers(
    df: DataFrame, value: str, sigma: float = SIGMA, by: Sequence[str] = ("batch_id",), baseline: DataFrame | None = None
) -> DataFrame:
    """Adds z_score and is_outlier (|z| > sigma).

    ``baseline(by…, mean_sim, std_sim, n)`` is the reference where it rests on enough samples,
    otherwise the group itself is.
    """
    by = list(by)
    own = df.groupBy(*by).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_std"))
    if baseline is not None:
        ready = baseline.where(F.col("n") >= MIN_BASELINE).select(*by, "mean_sim", "std_sim")
        own = own.join(ready, by, "left").select(
            *by, F.coalesce("mean_sim", "_mean").alias("_mean"), F.coalesce("std_sim", "_std").alias("_std")
        )
    stats = broadcast_if_small(checkpoint(own))
    z = F.when(F.col("_std") > 1e-12, (F.col(value) - F.col("_mean")) / F.col("_std")).otherwise(0.0)
    return (
        df.join(stats, by).withColumn("z_score", z)
        .withColumn("is_outlier", F.abs("z_score") > sigma).drop("_mean", "_std")
    )


def norm_outliers(vecs: DataFrame, sigma: float = 2.0) -> DataFrame:
    return zscore_outliers(vecs.withColumn("norm", norm("embedding")), "norm", sigma)


def mad_outliers(df: DataFrame, value: str, by: Sequence[str] = ("batch_id",), sigma: float = SIGMA) -> DataFrame:
    """Adds modified_z = 0.6745·(x - median)/MAD and is_outlier; all 0 where the MAD vanishes."""
    by = list(by)
    middle = checkpoint(percentiles(df, value, {"_median": 0.5}, by))
    near = df.join(broadcast_if_small(middle), by).withColumn("_gap", F.abs(F.col(value) - F.col("_median")))
    spreads = percentiles(near, "_gap", {"_mad": 0.5}, by)
    stats = checkpoint(middle.join(spreads, by))
    z = F.when(F.col("_mad") >= 1e-12, 0.6745 * (F.col(value) - F.col("_median")) / F.col("_mad")).otherwise(0.0)
    return (
        df.join(broadcast_if_small(stats), by).withColumn("modified_z", z)
        .withColumn("is_outlier", F.abs("modified_z") > sigma).drop("_median", "_mad")
    )


# --------------------------------------------------------------------------- baselines

def build_baseline(clean: DataFrame) -> DataFrame:
    """(batch_id, centroid, mean_sim, std_sim, n) of known clean vectors."""
    mids = checkpoint(centroid(clean))
    sims = sim_to_centroid(clean, mids).groupBy("batch_id").agg(
        F.avg("similarity").alias("mean_sim"), F.stddev_pop("similarity").alias("std_sim"), F.count("*").alias("n")
    )
    return sims.join(mids.select("batch_id", "centroid"), "batch_id")


def update_baseline(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Fresh baselines replace stored ones of the same batch."""
    return fresh.unionByName(stored.join(fresh.select("batch_id"), "batch_id", "left_anti"))


def merge_baseline(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Append: centroids, means and deviations pooled by sample count."""
    a, b = stored.alias("a"), fresh.alias("b")
    na, nb = F.coalesce("a.n", F.lit(0)), F.coalesce("b.n", F.lit(0))
    n = na + nb
    pool = lambda x, y: (F.coalesce(x, F.lit(0.0)) * na + F.coalesce(y, F.lit(0.0)) * nb) / n
    mean = pool(F.col("a.mean_sim"), F.col("b.mean_sim"))
    second = pool(
        F.pow("a.std_sim", F.lit(2.0)) + F.pow("a.mean_sim", F.lit(2.0)),
        F.pow("b.std_sim", F.lit(2.0)) + F.pow("b.mean_sim", F.lit(2.0)),
    )
    mids = F.when(F.col("a.centroid").isNull(), F.col("b.centroid")).when(
        F.col("b.centroid").isNull(), F.col("a.centroid")
    ).otherwise(F.zip_with("a.centroid", "b.centroid", lambda x, y: (x * na + y * nb) / n))
    return a.join(b, F.col("a.batch_id") == F.col("b.batch_id"), "full_outer").select(
        F.coalesce("a.batch_id", "b.batch_id").alias("batch_id"), mean.alias("mean_sim"),
        F.sqrt(F.greatest(second - mean * mean, F.lit(0.0))).alias("std_sim"), n.alias("n"), mids.alias("centroid"),
    )


def baseline_status(analyses: DataFrame) -> DataFrame:
    """Per tenant: total vectors analysed, time and state of the latest analysis."""
    return analyses.groupBy("tenant_id").agg(
        F.lit(True).alias("is_established"), F.sum("total_vectors").cast("bigint").alias("document_count"),
        F.max("created_at").alias("last_updated"), F.max_by("mean_norm", "created_at").alias("mean_norm"),
        F.max_by("std_norm", "created_at").alias("std_norm"),
    )


def centroid_drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """‖μ1 - μ0‖ / ‖μ0‖ between two snapshots' centroids."""
    both = old.select("batch_id", F.col("centroid").alias("c0")).join(
        new.select("batch_id", F.col("centroid").alias("c1")), "batch_id"
    )
    gap = F.zip_with("c1", "c0", lambda x, y: x - y)
    size = norm("c0")
    return both.select("batch_id", F.when(size > 0, norm(gap) / size).alias("drift"))


# --------------------------------------------------------------------------- scores and reports

def vector_scores(vecs: DataFrame, labels: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """Anomaly score and reasons for every vector, given its cluster label."""
    own = checkpoint(centroid(vecs))
    if baseline is not None:
        ready = baseline.where(F.col("n") >= MIN_BASELINE).select("batch_id", F.col("centroid").alias("_base"))
        own = own.join(ready, "batch_id", "left").select(
            "batch_id", "n", F.coalesce("_base", "centroid").alias("centroid")
        )
    scored = zscore_outliers(sim_to_centroid(vecs, own), "similarity", SIGMA, ["batch_id"], baseline)
    scored = scored.join(labels.select("vec_id", "cluster_label"), "vec_id")
    dev = 1.0 - F.col("similarity")
    noise = F.col("cluster_label") == -1
    score = clip01(
        0.40 * cap1(dev / 0.5) + 0.30 * cap1(F.abs("z_score") / 5.0)
        + F.when(noise, 0.20).otherwise(0.0) + F.when(F.col("is_outlier"), 0.10).otherwise(0.0)
    )
    reasons = F.array_compact(
        F.array(
            F.when(F.col("is_outlier"), F.format_string(f"Cosine deviation %.4f exceeds {SIGMA}-sigma threshold", dev)),
            F.when(
                F.col("similarity") < SIMILARITY_FLOOR,
                F.format_string(f"Similarity %.4f below threshold {SIMILARITY_FLOOR}", "similarity"),
            ),
            F.when(noise, "Classified as DBSCAN noise (potential outlier)"),
        )
    )
    return scored.select(
        "batch_id", "vec_id", score.alias("anomaly_score"), dev.alias("cosine_deviation"), "z_score",
        "cluster_label", "is_outlier", reasons.alias("reasons"),
    ).withColumn("is_flagged", F.size("reasons") > 0)


def split_view_bimodal(sims: DataFrame, by: Sequence[str] = ("batch_id",)) -> DataFrame:
    """Whether a group's flagged similarities (at least four) fall in two halves more than 0.15 apart."""
    by = list(by)
    flagged = sims.where(F.col("similarity") < SIMILARITY_FLOOR)
    mid = percentiles(flagged, "similarity", {"lower": 0.5}, by, method="straddle")
    n = flagged.groupBy(*by).agg(F.count("*").alias("flagged"))
    return sims.select(*by).distinct().join(n, by, "left").join(mid, by, "left").select(
        *by, F.coalesce("flagged", F.lit(0)).alias("flagged"),
        F.coalesce((F.col("flagged") >= 4) & (F.col("lower_next") - F.col("lower") > 0.15), F.lit(False)).alias("split_view"),
    )


def batch_report(vecs: DataFrame, profile: str = "service", labels: DataFrame | None = None, baseline: DataFrame | None = None) -> DataFrame:
    """One row per batch with counts, dispersion, risk and verdict of the chosen profile."""
    if profile == "service":
        return _service_report(vecs, labels, baseline)
    return {"edge": _edge_report, "router": _router_report}[profile](vecs)


def _service_report(vecs: DataFrame, labels: DataFrame | None, baseline: DataFrame | None) -> DataFrame:
    from sparkpoison.operators.clustering import cluster_stats, dbscan_cosine, split_view

    labels = checkpoint(labels if labels is not None else dbscan_cosine(vecs))
    scores = vector_scores(vecs, labels, baseline)
    counts = scores.groupBy("batch_id").agg(
        F.count("*").alias("total_vectors"), F.count_if("is_flagged").alias("flagged_count"),
    )
    splits = split_view(vecs, labels).groupBy("batch_id").agg(F.count("*").alias("split_view_count"))
    ready = (
        baseline.select("batch_id", (F.col("n") >= MIN_BASELINE).alias("baseline_sufficient"))
        if baseline is not None else None
    )
    out = (
        counts.join(dispersion_rate(vecs).select("batch_id", "dispersion_rate"), "batch_id")
        .join(cluster_stats(labels), "batch_id").join(splits, "batch_id", "left")
    )
    if ready is not None:
        out = out.join(ready, "batch_id", "left")
    else:
        out = out.withColumn("baseline_sufficient", F.lit(False))
    return out.fillna({"split_view_count": 0, "baseline_sufficient": False})


def _edge_report(vecs: DataFrame) -> DataFrame:
    sims = sim_to_centroid(vecs, centroid(vecs))
    scored = zscore_outliers(sims, "similarity", SIGMA)
    report = scored.groupBy("batch_id").agg(
        F.count("*").alias("total_vectors"),
        F.count_if(F.col("similarity") < SIMILARITY_FLOOR).alias("flagged_count"),
        F.count_if(F.abs("z_score") > SIGMA).alias("z_outliers"),
        (1.0 - F.min("similarity")).alias("max_deviation"),
    )
    out = report.join(split_view_bimodal(sims).select("batch_id", "split_view"), "batch_id")
    rate = F.col("flagged_count") / F.col("total_vectors")
    risk = clip01(
        0.4 * F.col("max_deviation") + 0.3 * rate + 0.2 * (F.col("z_outliers") / F.col("total_vectors"))
        + 0.1 * F.col("split_view").cast("double")
    )
    return (
        out.withColumn("dispersion_rate", rate)
        .withColumn("z_outlier_rate", F.col("z_outliers") / F.col("total_vectors"))
        .withColumn("risk_score", risk)
        .withColumn("verdict", banded(F.col("risk_score"), (0.6, "poisoned"), (0.3, "suspicious"), otherwise="clean"))
    )


def _router_scores(vecs: DataFrame) -> DataFrame:
    sims = sim_to_centroid(vecs, centroid(vecs), floor=1e-9)
    return zscore_outliers(sims.withColumn("dispersion", 1.0 - F.col("similarity")), "dispersion", SIGMA)


def _router_report(vecs: DataFrame) -> DataFrame:
    flagged = (F.col("similarity") < SIMILARITY_FLOOR) | (F.col("z_score") > SIGMA)
    out = _router_scores(vecs).groupBy("batch_id").agg(
        F.count("*").alias("total_vectors"), F.count_if(flagged).alias("flagged_vectors"),
        F.avg("dispersion").alias("mean_dispersion"), F.max("dispersion").alias("max_dispersion"),
        F.stddev_pop("dispersion").alias("std_dispersion"), F.max("z_score").alias("_z"),
    )
    score = 0.6 * (F.col("flagged_vectors") / F.col("total_vectors")) + 0.4 * cap1(F.col("_z") / SIGMA)
    return (
        out.withColumn("anomaly_score", score)
        .withColumn(
            "verdict",
            F.when(F.col("total_vectors") < MIN_BASELINE, "insufficient_data").otherwise(
                banded(F.col("anomaly_score"), (0.7, "poisoned"), (0.3, "suspicious"), otherwise="clean")
            ),
        ).drop("_z")
    )


def top_outliers(vecs: DataFrame, k: int = 10) -> DataFrame:
    """The k most dispersed vectors of each batch (pruned to k per task before the shuffle)."""
    w = Window.partitionBy("batch_id").orderBy(F.col("dispersion").desc(), "vec_id")
    return _router_scores(vecs).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(
        "batch_id", "rank", "vec_id", "dispersion", "similarity", "z_score"
    )
