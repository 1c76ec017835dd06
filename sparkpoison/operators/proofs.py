"""Hash chains over scan results.

A chain is sequential by definition, so records are chained in segments of 4096 consecutive
sequence numbers, and the last links of the segments are chained again, level by level, up to
one root per tenant. No task ever holds more than one segment; checking needs only each
record's predecessor and is fully parallel.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkpoison.session import checkpoint

SEGMENT = 4096


def _fold(rows: pd.DataFrame, genesis: str) -> pd.DataFrame:
    rows = rows.sort_values("idx")
    previous, links = None, []
    for result in rows["result_hash"]:
        previous = hashlib.sha256(((previous if previous is not None else genesis) + result).encode()).hexdigest()
        links.append(previous)
    return rows.assign(chain_hash=links)


def build_chain(log: DataFrame, genesis: str = "") -> DataFrame:
    """Chains ``log(tenant_id, idx, result)``; ``genesis`` is put before each segment's first hash.

    ``idx`` is a record's sequence number, so a segment holds at most 4096 records.
    """
    hashed = log.select(
        "tenant_id", "idx", F.floor(F.col("idx") / SEGMENT).alias("segment"), F.sha2("result", 256).alias("result_hash")
    )
    kinds = dict(hashed.dtypes)
    schema = f"tenant_id {kinds['tenant_id']}, idx {kinds['idx']}, segment bigint, result_hash string, chain_hash string"
    return hashed.groupBy("tenant_id", "segment").applyInPandas(lambda rows: _fold(rows, genesis), schema)


def chain_roots(chain: DataFrame, genesis: str = "") -> DataFrame:
    """One root hash per tenant, from the heads of its segments.

    A tenant is done when one head is left, whatever the other tenants still need, so a root
    depends on the tenant's own records alone.
    """
    heads = lambda c: c.groupBy("tenant_id", "segment").agg(F.max_by("chain_hash", "idx").alias("result"))
    level = checkpoint(heads(chain).withColumnRenamed("segment", "idx"))
    roots = []
    while True:
        left = level.groupBy("tenant_id").agg(F.count("*").alias("_heads"))
        counted = checkpoint(level.join(left, "tenant_id"))
        roots.append(counted.where("_heads = 1").select("tenant_id", F.col("result").alias("root_hash")))
        level = counted.where("_heads > 1").drop("_heads")
        if level.isEmpty():
            return reduce(DataFrame.union, roots)
        level = checkpoint(heads(build_chain(level, genesis)).withColumnRenamed("segment", "idx"))


def link_hash(previous: Column, result: Column, genesis: str = "") -> Column:
    return F.sha2(F.concat(F.coalesce(previous, F.lit(genesis)), result), 256)


def checked_links(chain: DataFrame, genesis: str = "") -> DataFrame:
    """Adds ``is_valid``: whether a record's link follows from the record before it."""
    w = Window.partitionBy("tenant_id", "segment").orderBy("idx")
    return chain.withColumn(
        "is_valid", F.col("chain_hash") == link_hash(F.lag("chain_hash").over(w), F.col("result_hash"), genesis)
    )


def verify_chain(chain: DataFrame, genesis: str = "", roots: DataFrame | None = None) -> DataFrame:
    """Per tenant: records, verified and failed links, first invalid record.

    With the stored ``roots(tenant_id, root_hash)`` also ``root_valid``: whether the records still lead to the root,
    which finds missing records at the end. A tenant with a root and no records is reported with 0 records.
    """
    ok = F.col("is_valid")
    out = checked_links(chain, genesis).groupBy("tenant_id").agg(
        F.count("*").alias("records"), F.count_if(ok).alias("verified"), F.count_if(~ok).alias("failed"),
        F.min(F.when(~ok, F.col("idx"))).alias("invalid_at"),
    )
    if roots is None:
        return out
    now = chain_roots(chain, genesis).withColumnRenamed("root_hash", "_now")
    both = out.join(now, "tenant_id").join(roots.select("tenant_id", "root_hash"), "tenant_id", "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    same = F.coalesce(F.col("_now") == F.col("root_hash"), F.lit(False)).alias("root_valid")
    return both.select("tenant_id", zero("records"), zero("verified"), zero("failed"), "invalid_at", same)
