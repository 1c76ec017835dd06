"""Named queries over the test tables, each with the SQL that checks it."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from sparkpoison.plans.views import table, with_views

MODULES = ["text", "vectors", "mcp", "provenance", "traces", "drift", "fusion", "dashboard", "response", "streams"]


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    check: str | None
    covers: str


_QUERIES: dict[str, Query] = {}


def query(covers: str, views: str = "", check: str | None = None, inputs: str | None = None, stream: bool = False):
    """Register ``fn(*tables)``: it receives the named tables and views as DataFrames.

    ``covers`` lists the inventory IDs; ``views`` are the derived views the check SQL uses
    (and, unless ``inputs`` says otherwise, the DataFrames passed to the function).
    ``stream`` passes streaming DataFrames.
    """

    def wrap(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        names = (inputs if inputs is not None else views).split()

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(*[table(spark, sf_dir, n, stream) for n in names])

        run.__doc__ = fn.__doc__
        derived = " ".join(v for v in views.split() if _is_view(v))
        _QUERIES[fn.__name__] = Query(run, with_views(derived, check) if check else None, covers)
        return fn

    return wrap


def _is_view(name: str) -> bool:
    from sparkpoison.plans.views import _VIEWS

    return name in _VIEWS


def load() -> dict[str, Query]:
    for module in MODULES:
        importlib.import_module(f"sparkpoison.plans.{module}")
    return dict(_QUERIES)
