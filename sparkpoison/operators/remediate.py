"""Remediation: rules matched to findings, and their effect on the assets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sparkpoison.session import broadcast_if_small


def match_rules(events: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds the first enabled rule (by priority) for each event's engine and severity, and its status.

    Rules are reduced to one per engine and severity first, so events are never shuffled.
    """
    columns = ["rule_id", "action", "mode"]
    first = rules.where("enabled").groupBy("engine", "severity").agg(
        F.min_by(F.struct(*columns), F.struct("priority", "rule_id")).alias("r")
    )
    status = F.when(F.col("r.mode") == "auto", "executed").when(F.col("r").isNotNull(), "pending")
    return events.join(broadcast_if_small(first), ["engine", "severity"], "inner").select(
        *events.columns, "r.rule_id", "r.action", "r.mode", status.alias("status")
    )


def apply_actions(assets: DataFrame, log: DataFrame, action: str = "quarantine") -> DataFrame:
    """The assets left once everything whose latest ``log(entity_id, action, status, at)`` entry is executed is set aside.

    A later rollback brings the asset back.
    """
    latest = log.where(F.col("action") == action).groupBy("entity_id").agg(F.max_by("status", "at").alias("_status"))
    gone = latest.where(F.col("_status") == "executed").select("entity_id")
    return assets.join(gone, "entity_id", "left_anti")
