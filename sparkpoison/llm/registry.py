"""Queries of the training-data operators and the SQL that checks them, one module per operator."""

from __future__ import annotations

import importlib

import corpus_pipeline

#: module of this subpackage, in the order of the operators
MODULES = ["url_filter", "embedding_dedup", "license_scan", "bpe", "token_count", "quality", "jaccard_join", "decontaminate", "secrets", "sharding",
           "periodic_runs", "token_alignment", "metric_search"]


def load() -> tuple[dict, dict]:
    """({name: callable(spark, sf_dir)}, {name: SQL}) of every operator and of the pipeline."""
    queries, checks = {}, {}
    for module in MODULES:
        found = importlib.import_module(f"sparkpoison.llm.{module}")
        queries |= found.QUERIES
        checks |= found.ORACLE_SQL
    queries["pipeline"] = corpus_pipeline.run
    if corpus_pipeline.ORACLE_SQL:
        checks["pipeline"] = corpus_pipeline.ORACLE_SQL
    return queries, checks
