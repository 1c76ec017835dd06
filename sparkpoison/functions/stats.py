"""Exact order statistics and row positions that never gather a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkpoison.session import checkpoint

#: bits of a value's image that one round settles
DIGIT = 16


def percentiles(
    df: DataFrame,
    value: str,
    probs: dict[str, float],
    by: Sequence[str] = (),
    method: str = "linear",
) -> DataFrame:
    """Exact percentiles per group, one column per name in ``probs``.

    ``method`` is ``"linear"`` (interpolated), ``"nearest"`` (rank ceil(p·n)) or ``"straddle"``
    (the values at ranks floor(p·n) and floor(p·n)+1, the second as ``<name>_next``).

    Radix selection: a double has a 64-bit image of the same order, of which each of four rounds settles 16 bits. Values are
    counted per group and distinct value once (map-side); a round counts them by the next 16 bits, keeps the one bucket
    that holds a wanted rank, and goes on inside it. So a task orders at most 65536 counts, however many rows or distinct
    values a group has. NaN is the largest value, -0.0 equals 0.0; a group without values has no row.
    """
    by = list(by)
    names = list(probs)
    src = df.where(F.col(value).isNotNull()).select(*by, (F.col(value).cast("double") + F.lit(0.0)).alias("_v"))
    counts = src.groupBy(*by, "_v").agg(F.count("*").alias("_c")).withColumn("_i", image("_v"))
    per_prob = []
    for name in names:
        p = float(probs[name])
        if method == "linear":
            rank = F.lit(p) * (F.col("_n") - 1)
            first, frac = F.floor(rank), rank - F.floor(rank)
        elif method == "straddle":
            first, frac = F.greatest(F.floor(F.lit(p) * F.col("_n")) - 1, F.lit(0)), F.lit(0.0)
        else:
            ceil_rank = F.ceil(F.lit(p) * F.col("_n")) - 1
            first, frac = F.greatest(F.least(ceil_rank, F.col("_n") - 1), F.lit(0)), F.lit(0.0)
        for side in (0, 1) if method != "nearest" else (0,):
            per_prob.append(F.struct(
                F.lit(name).alias("name"), F.lit(side).alias("side"), (first.cast("bigint") + side).alias("k"), frac.cast("double").alias("frac")
            ))
    asked = ["name", "side", "k", "frac"]
    top = counts.groupBy(*by, F.shiftright("_i", 64 - DIGIT).alias("_q")).agg(F.sum("_c").alias("_s"))
    group = Window.partitionBy(*by)
    top = top.select("*", F.sum("_s").over(group).alias("_n"), F.sum("_s").over(group.orderBy("_q")).alias("_upto"))
    wanted = _bucket(top.select(*by, "_q", "_s", "_n", "_upto", F.explode(F.array(*per_prob)).alias("w")).where(F.col("w.k") < F.col("_n")), "w.", by)
    order = Window.partitionBy(*by, "name", "side").orderBy("_q")
    for settled in range(DIGIT, 64, DIGIT):
        rows = counts.withColumn("_p", F.shiftright("_i", 64 - settled))
        rows = _joined(rows, wanted if by else F.broadcast(wanted), [*by, "_p"])  # without groups: two rows per probability
        digits = F.shiftright("_i", max(0, 64 - settled - DIGIT)).alias("_q")
        buckets = rows.groupBy(*by, *asked, digits).agg(F.sum("_c").alias("_s"), F.min("_v").alias("_v"))
        buckets = buckets.withColumn("_upto", F.sum("_s").over(order))
        wanted, last = _bucket(buckets, "", by), _bucket(buckets, "", by, "_v")
    at = lambda name, side, what: F.max(F.when((F.col("name") == name) & (F.col("side") == side), F.col(what)))
    ends = [at(n, side, "_v").alias(f"_{i}_{side}") for i, n in enumerate(names) for side in (0, 1)]
    picked = last.groupBy(*by).agg(*ends, *[at(n, 0, "frac").alias(f"_{i}_f") for i, n in enumerate(names)])
    out = []
    for i, n in enumerate(names):
        a, b, f = F.col(f"_{i}_0"), F.col(f"_{i}_1"), F.col(f"_{i}_f")
        out.append(F.when(f > 0, a + (b - a) * f).otherwise(a).alias(n))
        if method == "straddle":
            out.append(b.alias(f"{n}_next"))
    return picked.select(*by, *(out if method != "straddle" else out[::2] + out[1::2]))


def _bucket(buckets: DataFrame, rank: str, by: Sequence[str], *more: str) -> DataFrame:
    """The bucket that holds each wanted rank, and the rank inside it."""
    k, before = F.col(f"{rank}k"), F.col("_upto") - F.col("_s")
    names = [F.col(f"{rank}{c}").alias(c) for c in ("name", "side", "frac")]
    return buckets.where((F.col("_upto") > k) & (before <= k)).select(*by, *names, (k - before).alias("k"), F.col("_q").alias("_p"), *more)


def image(value: str) -> Column:
    """A whole number of the same order as the double: its bits, the lower 63 turned round below zero."""
    bits = F.expr(f"CAST(java_method('java.lang.Double', 'doubleToLongBits', {value}) AS bigint)")
    return F.when(bits < 0, bits.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(bits)


def _joined(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on keys that may be null, which come from the left side; without keys, every row with every row of ``right``."""
    renamed = right.withColumnsRenamed({k: f"_r{i}" for i, k in enumerate(keys)})
    test = F.lit(True)
    for i, k in enumerate(keys):
        test = test & F.col(k).eqNullSafe(F.col(f"_r{i}"))
    return left.join(renamed, test).drop(*[f"_r{i}" for i in range(len(keys))])


def with_position(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "pos") -> DataFrame:
    """Number rows 1..n per group in the given order without sorting a group in one task.

    Rows are range-partitioned on (group, order), so a large group is a run of several
    tasks; each task's rows are numbered locally and shifted by the row counts of the
    group's earlier tasks (one row per task and group).
    """
    by = list(by)
    keys = [F.col(k) for k in by]
    tagged = checkpoint(
        df.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    task = F.shiftright("_mid", 33)
    tagged = tagged.withColumn("_task", task)
    per = tagged.groupBy(*by, "_task").agg(F.min("_mid").alias("_first"), F.count("*").alias("_n"))
    w = Window.partitionBy(*by).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)],
        F.col("_task").alias("_ptask"), "_first", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_base"),
    )
    test = F.col("_task") == F.col("_ptask")
    for i, k in enumerate(by):
        test = test & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return (
        tagged.join(per, test)
        .withColumn(name, F.col("_base") + F.col("_mid") - F.col("_first") + 1)
        .drop("_mid", "_task", "_ptask", "_first", "_base", "_n", *[f"_k{i}" for i in range(len(by))])
    )
