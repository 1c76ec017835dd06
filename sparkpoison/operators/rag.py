"""Whole-document risk reports built on the text detectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sparkpoison.functions import catalogue as cat
from sparkpoison.functions.numeric import banded, cap1, clip01
from sparkpoison.functions.vector import cosine, norm
from sparkpoison.operators import text as tx
from sparkpoison.session import broadcast_if_small


def cosine_deviation(docs: DataFrame, baseline: DataFrame, embedding: str = "embedding") -> DataFrame:
    """1 - similarity to the baseline centroid, in [0, 2]. ``baseline`` has one centroid per ``batch_id``.

    Documents without an embedding or a baseline deviate by 0. There are few batches, and
    one may hold most documents: their centroids go to the documents if they are small
    enough, else the join is left to Spark, which splits hot batches.
    """
    joined = docs.join(broadcast_if_small(baseline.select("batch_id", "centroid")), "batch_id", "left")
    ready = F.col(embedding).isNotNull() & F.col("centroid").isNotNull()
    dev = F.greatest(F.least(1.0 - cosine(embedding, "centroid"), F.lit(2.0)), F.lit(0.0))
    return joined.withColumn("cosine_deviation", F.when(ready, dev).otherwise(0.0)).drop("centroid")


def service_counts(text: Column | str) -> tuple[Column, Column]:
    """(hidden instructions, homoglyphs) of a text: invisible characters, payloads and pattern matches."""
    patterns = [(p, fold) for _, _, _, p, fold in cat.INJECTION_PATTERNS]
    payloads = F.when(F.col(text).rlike(tx.BASE64_RUN), F.size(tx.payload_list(text))).otherwise(0)
    hidden = tx.count_points(text, cat.INVISIBLE) + payloads + tx.match_count(text, patterns)
    return hidden.cast("bigint"), tx.count_points(text, cat.HOMOGLYPHS).cast("bigint")


def rag_scan(docs: DataFrame, profile: str = "service", deviation: str | None = None) -> DataFrame:
    """Risk report per document of ``docs(doc_id, text, …)``.

    ``deviation`` names a column with the cosine deviation; without it the deviation is 0.
    Column expressions on the text come first and pass through the scan that computes its
    statistics: one pass over the table, no join and no shuffle.
    """
    dev = F.col(deviation) if deviation else F.lit(0.0)
    return {"service": _service, "edge": _edge, "router": _router}[profile](docs, dev)


def _service(docs: DataFrame, dev: Column) -> DataFrame:
    return service_report(_service_scan(docs.withColumn("cosine_deviation", dev), ["cosine_deviation"]))


def _service_scan(docs: DataFrame, keep: list[str]) -> DataFrame:
    hidden, homoglyphs = service_counts("text")
    local = docs.select("doc_id", "text", *keep, hidden.alias("hidden"), homoglyphs.alias("homoglyphs"))
    return tx.text_stats(
        local, ["perplexity", "coherence", "entropy_anomalies", "ngram_anomalies"], keep=[*keep, "hidden", "homoglyphs"],
    )


def service_scan(docs: DataFrame, deviations: DataFrame) -> DataFrame:
    """The service report with the deviations ``(doc_id, cosine_deviation)`` of another table, 0 where it has none.

    They join the statistics, a few numbers a document: texts and embeddings stay in the tasks that read them.
    """
    joined = _service_scan(docs, []).join(deviations, "doc_id", "left")
    return service_report(joined.withColumn("cosine_deviation", F.coalesce("cosine_deviation", F.lit(0.0))))


def service_report(scanned: DataFrame) -> DataFrame:
    """Signals and risk from the statistics of the service profile and the cosine deviation."""
    d, ppl, coh = F.col("cosine_deviation"), F.col("perplexity"), F.col("coherence")
    signals = F.array_compact(
        F.array(
            F.when(d > 0.25, "cosine_deviation"),
            F.when(tx.perplexity_band(ppl, "service") > 0, "high_perplexity"),
            F.when(coh < 0.60, "low_coherence"),
            F.when(F.col("ngram_anomalies") > 0, "ngram_anomalies"),
            F.when(F.col("homoglyphs") > 0, "homoglyphs"),
            F.when(F.col("hidden") > 0, "hidden_instructions"),
            F.when(F.col("entropy_anomalies") > 0, "entropy_anomalies"),
        )
    )
    risk = clip01(
        0.25 * cap1(d / 0.5)
        + 0.10 * cap1(ppl / 200.0)
        + 0.10 * (1.0 - coh)
        + 0.15 * cap1(F.col("hidden") / 3.0)
        + 0.15 * cap1(F.col("entropy_anomalies") / 5.0)
        + 0.10 * cap1(F.col("homoglyphs") / 10.0)
        + 0.15 * cap1(F.col("ngram_anomalies") / 5.0)
    )
    return (
        scanned.withColumn("risk_score", risk)
        .withColumn("signals", signals)
        .withColumn("is_suspicious", F.size("signals") > 0)
    )


def _edge(docs: DataFrame, dev: Column) -> DataFrame:
    local = docs.select(
        "doc_id", "text",
        tx.count_points("text", cat.EDGE_HOMOGLYPHS).cast("bigint").alias("homoglyph_count"),
        tx.pattern_count("text", cat.EDGE_INJECTION_PATTERNS).alias("hidden_instruction_count"),
        F.regexp_count("text", F.lit(tx.EDGE_BASE64_RUN)).cast("bigint").alias("base64_count"),
    )
    kept = ["homoglyph_count", "hidden_instruction_count", "base64_count"]
    out = tx.text_stats(local, ["char_entropy", "perplexity_edge"], keep=kept).select(
        "doc_id", F.col("char_entropy").alias("entropy"), F.col("perplexity_edge").alias("perplexity"),
        tx.entropy_band(F.col("char_entropy")).alias("entropy_anomaly"),
        tx.perplexity_band(F.col("perplexity_edge")).alias("perplexity_anomaly"),
        "homoglyph_count", "hidden_instruction_count", "base64_count",
    )
    risk = clip01(
        0.15 * F.col("entropy_anomaly")
        + 0.15 * F.col("perplexity_anomaly")
        + 0.20 * cap1(F.col("homoglyph_count") / 5.0)
        + 0.30 * cap1(F.col("hidden_instruction_count") / 3.0)
        + 0.20 * cap1(F.col("base64_count") / 3.0)
    )
    return out.withColumn("risk_score", risk).withColumn(
        "verdict", banded(F.col("risk_score"), (0.6, "poisoned"), (0.3, "suspicious"), otherwise="clean")
    )


def _router(docs: DataFrame, dev: Column) -> DataFrame:
    local = docs.select("doc_id", "text", dev.alias("cosine_deviation"), tx.attack_type("text", dev).alias("attack_type"))
    out = tx.bigram_entropy(local, keep=["cosine_deviation", "attack_type"])
    d, ppl, attack = F.col("cosine_deviation"), F.col("perplexity_score"), F.col("attack_type").isNotNull()
    risk = cap1(0.5 * d + 0.3 * (1.0 - ppl) + F.when(attack, 0.2).otherwise(0.0))
    return (
        out.withColumn("is_flagged", (d > 1.0 - 0.85) | F.col("is_low") | attack)
        .withColumn("risk_score", risk)
        .withColumn("verdict", banded(F.col("risk_score"), (0.7, "poisoned"), (0.3, "suspicious"), otherwise="clean"))
        .drop("is_low")
    )


def norm_of(embedding: str = "embedding") -> Column:
    return norm(embedding)
