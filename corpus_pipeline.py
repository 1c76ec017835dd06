"""Training-data pipeline over ``documents``: five stages, each on all that the stage before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the
columns of ``docs``. Null and empty texts pass the filters unless the classifier rejects them;
rows without id are never dropped as duplicates; empty tables stay empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkpoison.llm import bpe, decontaminate, jaccard_join, quality, secrets
from sparkpoison.llm.common import read
from sparkpoison.session import shared_dir


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from their labels, does not reject."""
    forest = quality.train(docs, read(spark, sf_dir, "labels", "doc_id", "quality"))
    inner = [f"c{i}" for i in range(len(docs.columns))]  # a column score or predicted of the documents is theirs
    judged = quality.classify(docs.toDF(*inner), forest, text=inner[docs.columns.index("text")])
    return judged.where("predicted = 1").select(*inner).toDF(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of smallest id, of every component of near-duplicates (five words, similarity 0.8)."""
    return jaccard_join.drop_near_duplicates(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item (five words, containment 0.8)."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark", "item_id", "text"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret replaced by a mark; ``n_chars`` follows the text."""
    masked = secrets.redact(docs)
    if "n_chars" not in docs.columns:
        return masked
    kind = docs.schema["n_chars"].dataType
    changed = F.coalesce(F.length("text").cast(kind), F.col("n_chars"))
    return masked.withColumn("n_chars", changed)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, their number, and digests of the ids and of the decoded bytes."""
    keep = [c for c in docs.columns if c not in ("text", "ids", "offsets", "n_tokens", "ids_sha256", "decoded_sha256")]
    coded = bpe.round_trip(docs, bpe.vocabulary_path("byte_bpe_50k.tiktoken"), keep, ids=True)
    return coded.drop("offsets")


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("benchmark decontamination", keep_uncontaminated),
    ("secret scans", mask_secrets),
    ("byte-level BPE", to_tokens),
]

#: A learned classifier, components and a tokenizer are no SQL; tests/llm checks the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is a table in the shared folder, which the next one reads.

    The result reads the last of these tables, so they are not removed here: the folder's owner does, as with checkpoints.
    """
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
