"""Running totals inside an array column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

#: elements added up one after the other before block totals take over
_BLOCK = 128


def running(df: DataFrame, name: str, joined: Callable[[Column, Column], Column] = lambda a, x: a + x) -> DataFrame:
    """Replace the array of integers ``name`` by its running sums (or other totals from 0).

    Block by block: a fold that appends would copy the whole array at every element, and a sum
    per element would be quadratic as well. An empty or null array becomes empty.
    """
    total = lambda xs: F.aggregate(xs, F.lit(0), joined)
    blocks = F.when(F.size(name) > 0, F.transform(
        F.sequence(F.lit(0), ((F.size(name) - 1) / _BLOCK).cast("int")), lambda b: F.slice(F.col(name), b * _BLOCK + 1, _BLOCK)
    )).otherwise(F.array().cast("array<array<int>>"))
    df = df.withColumn("_in", F.transform(blocks, lambda blk: F.transform(blk, lambda _, i: total(F.slice(blk, F.lit(1), i + 1)))))
    df = df.withColumn("_totals", F.transform("_in", lambda blk: F.element_at(blk, -1)))
    offsets = F.transform("_totals", lambda _, i: total(F.slice(F.col("_totals"), F.lit(1), i)))
    summed = F.zip_with("_in", offsets, lambda blk, o: F.transform(blk, lambda e: joined(o, e)))
    return df.withColumn(name, F.flatten(summed)).drop("_in", "_totals")
