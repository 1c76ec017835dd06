import zlib

import numpy as np

from sparkpoison.llm import quality as Q


def auc(y, p):
    order = np.argsort(p, kind="stable")
    rank = np.empty(len(p))
    rank[order] = np.arange(1, len(p) + 1)
    n1 = y.sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / max(n1 * (len(y) - n1), 1)


def test_held_out(spark):
    d = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in Q.op6_quality(spark, d).collect()}
    n = spark.read.parquet(f"{d}/documents.parquet").count()
    assert len(got) == n
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    labels = [(r["quality"], got[r["doc_id"]]) for r in spark.read.parquet(f"{d}/labels.parquet").collect() if r["doc_id"] in got]
    y = np.array([q for q, r in labels if r["held_out"]])
    p = np.array([r["score"] for _, r in labels if r["held_out"]])
    assert auc(y, p) > 0.9
    assert np.mean((p >= 0.3) == y) > 0.9


def test_statistics_of_one_text_do_not_depend_on_others():
    texts = [b"", b"A b c.\nA b c.\n", "é é é".encode(), b"one", b"WORD!! WORD!! x", b" \n "]
    together = Q.statistics(texts)
    assert np.allclose(together, np.concatenate([Q.statistics([t]) for t in texts]))
    assert not together[0].any() and np.isfinite(together).all()


def test_forest_learns_and_bounds():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    assert auc(y, Q.grow(x, y).score(x)) > 0.97
    assert np.allclose(Q.grow(np.zeros((0, 5)), np.zeros(0)).score(x), 0.5)
    assert (Q.grow(x, np.ones(2000)).score(x) > 0.9).all()


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 6), (None, "text here", 7), (3, "x" * 50_000, 8), (3, "x" * 50_000, 8)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0), (3, 0), (3, 1)], "doc_id long, quality int")
    forest = Q.train(docs, labels)
    assert Q.classify(docs, forest).count() == 5 and Q.classify(docs.limit(0), forest).count() == 0
    assert Q.train(docs, labels.limit(0)).score(np.zeros((1, len(Q.STATISTICS))))[0] == 0.5
    assert len(Q.train(docs, labels, max_rows=1).leaf) == 80
