"""Every stage against plain Python, on what the stage before kept."""

import hashlib
import re

import brute
import corpus_pipeline

import pytest
from pyspark.sql import functions as F

from test_decontaminate import brute as contained
from test_jaccard import brute as components
from test_tokenizers import library  # noqa: F401

from sparkpoison.llm import quality

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], SF).write.parquet(f"{folder}/{n}")
        out.append(spark.read.parquet(f"{folder}/{n}"))
    return [sorted(map(lambda r: r.asDict(), df.collect()), key=lambda r: r["doc_id"]) for df in out]


def test_columns(stages):
    for part in stages[1:5]:
        assert set(part[0]) == set(stages[0][0])


def test_quality(spark, stages):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    forest = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    score = forest.score(quality.statistics([(r["text"] or "").encode() for r in stages[0]]))
    assert stages[1] == [r for r, p in zip(stages[0], score) if p >= 0.3]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in stages[1]}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in good) / len(good) > 0.97
    assert sum(i in kept for i, q in labels.items() if q == 0) < 0.4 * sum(q == 0 for q in labels.values())


def test_one_of_each_group(stages):
    first = {i for i, _, c in components([(r["doc_id"], r["text"]) for r in stages[1]], 5, 80) if i == c}
    assert stages[2] == [r for r in stages[1] if r["doc_id"] in first]
    assert len(stages[2]) < len(stages[1])


def test_decontaminated(spark, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {d for d, *_ in contained([(r["doc_id"], r["text"]) for r in stages[2]], items)}
    assert bad and stages[3] == [r for r in stages[2] if r["doc_id"] not in bad]


def test_masked(stages):
    assert [r["doc_id"] for r in stages[4]] == [r["doc_id"] for r in stages[3]]
    changed = 0
    for before, after in zip(stages[3], stages[4]):
        spans = brute.secrets(before["text"])[1]
        assert not spans or after["text"] != before["text"]
        assert not any(brute.secrets(after["text"])[0])
        pieces = [re.escape(p) for p in after["text"].split("<secret>")]
        assert re.fullmatch("(?s)" + ".+?".join(pieces), before["text"]) and after["n_chars"] == len(after["text"])
        changed += before["text"] != after["text"]
    assert changed


def test_tokens(stages, library):  # noqa: F811
    for before, after in zip(stages[4], stages[5]):
        assert after["ids"] == library.encode_ordinary(before["text"]) and after["n_tokens"] == len(after["ids"])
        assert after["decoded_sha256"] == hashlib.sha256(before["text"].encode()).hexdigest()


def test_run(spark, stages):
    got = sorted(corpus_pipeline.run(spark, SF).collect(), key=lambda r: r["doc_id"])
    assert [r.asDict() for r in got] == stages[5]


def test_edges(spark):
    """Nulls, repeated rows, an empty table."""
    rows = [(1, None, "en", "s", 0), (1, None, "en", "s", 0), (None, "a secret: abcdefghij", "en", "s", 5), (2, "", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for part in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            part = stage(spark, part, SF)
        part.count()


def test_clashing_columns(spark):
    """Columns of the documents named as the stages' own stay as they are."""
    extra = {"score": 7, "predicted": 8, "_k1": 9, "_k2": 10, "k1": 11, "k2": 12, "f1": 13, "_text": 14, "c0": 15, "component_id": 16}
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    for name, value in extra.items():
        docs = docs.withColumn(name, F.lit(value))
    part = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        part = stage(spark, part, SF)
        assert part.columns == docs.columns
    rows = part.collect()
    assert rows and all(r[name] == value for r in rows for name, value in extra.items())
