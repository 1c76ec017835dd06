"""Small column expressions shared by the scorers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def round_to(value: Column | str, digits: int) -> Column:
    """Decimal half-up rounding of a double.

    The 1e-6 absorbs binary representation error, so 0.04305 rounds to 0.0431 whatever
    order its terms were added in.
    """
    col = F.col(value) if isinstance(value, str) else value
    scale = float(10**digits)
    return F.floor(col.cast("double") * scale + 0.500001) / scale


def cap1(value: Column) -> Column:
    return F.least(value, F.lit(1.0))


def clip01(value: Column) -> Column:
    return F.greatest(F.least(value, F.lit(1.0)), F.lit(0.0))


def banded(value: Column, *bands: tuple[float, str], otherwise: str) -> Column:
    """First label whose lower bound the value reaches, highest bound first."""
    expr = None
    for bound, label in bands:
        test = value >= bound
        expr = F.when(test, label) if expr is None else expr.when(test, label)
    return expr.otherwise(otherwise)


def count_if(test: Column) -> Column:
    return F.count_if(test)


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 when there is no whole."""
    return F.when(whole > 0, part / whole).otherwise(0.0)
