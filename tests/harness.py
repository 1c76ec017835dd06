"""Compare registered queries with their check SQL in DuckDB."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf_dir, t)}.parquet'")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, decimal.Decimal)):
        return float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr), [columns[i] for i in order]


def compare(spark, con, fn, sql, sf_dir):
    """None when equal, else a description of the first difference; also the row count."""
    df = fn(spark, sf_dir)
    got, cols = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want, wcols = rows_of(names, cur.fetchall())
    if cols != wcols:
        return f"columns {cols} != {wcols}", len(got)
    if len(got) != len(want):
        extra = [x for x in got if x not in set(want)][:2]
        missing = [x for x in want if x not in set(got)][:2]
        return f"{len(got)} rows, want {len(want)}; extra {extra} missing {missing}", len(got)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} rows differ, e.g. got {bad[0][0]} want {bad[0][1]}; columns {cols}", len(got)
    return None, len(got)
