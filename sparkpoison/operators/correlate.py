"""Cross-engine correlation: one timeline, kill-chain stages, attack clusters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from sparkpoison.functions import catalogue as cat
from sparkpoison.operators.clustering import connected_components
from sparkpoison.session import broadcast_if_small, checkpoint


def unified_timeline(*findings: DataFrame) -> DataFrame:
    """All engines' findings on one time axis."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), findings)


def classify(findings: DataFrame) -> DataFrame:
    """Adds the kill-chain ``stage`` of each finding's technique."""
    stages = F.create_map(*[F.lit(x) for pair in cat.KILL_CHAIN.items() for x in pair])
    return findings.withColumn("stage", stages[F.col("technique")])


def _cell(at: Column | str, minutes: int) -> Column:
    return F.floor(F.unix_micros(at) / (minutes * 60_000_000))


def clusters(findings: DataFrame, minutes: int = 60, smallest: int = 2) -> DataFrame:
    """Adds ``cluster_id`` (smallest event of the cluster) to events that correlate with another.

    Two events belong together when they are less than ``minutes`` apart and share an entity
    or a stage. Time is cut into cells of that length: events of one key in one cell always
    belong together, and neighbouring cells do when the last event of one and the first of
    the next are close enough. Every event has a stage, so components are found among the
    stages of the cells alone: an entity joins the stages that it has in a cell, and the least
    of these with its least one of the next cell. No pair of events is formed, and what is
    iterated over grows with the cells, not with the events.
    """
    events = findings.where(F.col("stage").isNotNull()).withColumn("_cell", _cell("ts", minutes))
    events = events.withColumn("_s", F.to_json(F.struct(F.col("stage").cast("string").alias("v"), F.col("_cell").alias("c"))))
    own = events.groupBy("_s").agg(F.first("stage").alias("k"), F.first("_cell").alias("_cell"), F.min("ts").alias("lo"), F.max("ts").alias("hi"),
                                   F.min("event_id").alias("least"), F.count("*").alias("n"))
    own = checkpoint(own.withColumn("low", F.col("_s")))
    held = checkpoint(
        events.where(F.col("entity_id").isNotNull()).groupBy(F.col("entity_id").cast("string").alias("k"), "_cell")
        .agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.min("_s").alias("low"), F.collect_set("_s").alias("all"))
    )
    parts = [own.select(F.col("_s").alias("u"), F.col("_s").alias("v")), held.select(F.col("low").alias("u"), F.explode("all").alias("v")).distinct()]
    for rows in (own, held):
        rows = rows.select("k", "_cell", "lo", "hi", "low")
        after = rows.select("k", (F.col("_cell") - 1).alias("_cell"), F.col("lo").alias("_lo"), F.col("low").alias("v"))
        close = F.unix_micros("_lo") - F.unix_micros("hi") < minutes * 60_000_000
        parts.append(rows.join(after.hint("merge"), ["k", "_cell"]).where(close).select(F.col("low").alias("u"), "v").distinct())
    component = checkpoint(connected_components(reduce(DataFrame.union, parts)))
    placed = own.select("_s", "least", "n").join(component.withColumnRenamed("node", "_s"), "_s")
    names = placed.groupBy("component").agg(F.min("least").alias("cluster_id"), F.sum("n").alias("_n")).where(F.col("_n") >= smallest)
    named = broadcast_if_small(checkpoint(placed.join(names, "component").select("_s", "cluster_id")))
    return events.join(named, "_s").drop("_cell", "_s")


def cluster_summary(clustered: DataFrame) -> DataFrame:
    """Per cluster: span, size, entities, engines and events per stage."""
    minutes = (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 60_000_000.0
    per_stage = [F.count_if(F.col("stage") == s).alias(s) for s in cat.STAGES]
    return clustered.groupBy("cluster_id").agg(
        F.count("*").alias("events"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
        F.count_distinct("entity_id").alias("entities"), F.count_distinct("engine").alias("engines"),
        minutes.alias("span_minutes"), *per_stage,
    )


def correlation_totals(findings: DataFrame, clustered: DataFrame) -> DataFrame:
    n = findings.agg(F.count("*").alias("n"))
    return clustered.agg(F.count("*").alias("correlated_events"), F.count_distinct("cluster_id").alias("clusters")).select(
        n.scalar().alias("total_events"), "correlated_events", (n.scalar() - F.col("correlated_events")).alias("uncorrelated_events"), "clusters",
    )
