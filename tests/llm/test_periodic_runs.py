import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from sparkpoison.llm import periodic_runs as runs_of


def every_lag(words, shortest=12):
    """All runs by comparing words at every lag; a run's smallest period is the first lag that finds it."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(shortest, 2 * q):
                found.setdefault((i, length), q)
            i = j + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def planted(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def expected(doc_id, words):
    runs = sorted(every_lag(words), key=lambda r: (r[0], r[2]))
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    tail = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(runs), *tail, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def found(texts, shortest=12):
    code = np.array([w for t in texts for w in t], np.int64)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    first = np.cumsum([0, *map(len, texts)])
    out = [[] for _ in texts]
    for s, length, q in zip(*runs_of.find_runs(code, owner, shortest)):
        out[owner[s]].append((int(s - first[owner[s]]), int(length), int(q)))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), max_size=4), st.sampled_from([2, 5, 12]))
def test_all_runs_of_few_words(texts, shortest):
    assert found(texts, shortest) == [every_lag(t, shortest) for t in texts]


def test_runs_in_long_and_regular_texts():
    rng = random.Random(5)
    fib = [[0], [1]]
    while len(fib[-1]) < 600:
        fib.append(fib[-1] + fib[-2])
    block = [rng.randrange(50) for _ in range(90)]
    texts = [fib[-1], [0] * 700, [0] * 300 + [1] + [0] * 300 + [1] + [0] * 40, block * 5 + block[:17], [rng.randrange(300) for _ in range(900)], [], [1] * 11, [1] * 12, list(range(6)) * 2, list(range(5)) * 2]
    texts += [block[:30] * 2 + block[:30] + [7] + block[:30] * 3]
    assert found(texts) == [every_lag(t) for t in texts]


def test_long_texts_take_n_log_n():
    words = [0] * 300_000 + [1] + [0] * 300_000 + [2 + i for i in range(40_000)] * 3
    start, length, period = runs_of.find_runs(np.array(words), np.zeros(len(words), np.int64), 12)
    assert list(zip(start.tolist(), length.tolist(), period.tolist())) == [(0, 300_000, 1), (300_001, 300_000, 1), (600_001, 120_000, 40_000)]


def test_splitting_keeps_all_words_of_runs():
    words = np.array([9, 1, 2, 3, 1, 2, 3, 1, 2, 3, 1, 2, 3, 8, 4, 5, 4, 6, 7, 6])
    assert runs_of.split_by_frequency(words, np.zeros(len(words), np.int64), 12).tolist() == list(range(1, 13))


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {tuple(r) for r in runs_of.op11_periodic_runs(spark, sf_dir).collect()}
    assert got == {expected(r["doc_id"], planted(r["doc_id"], r["text"])) for r in docs}
    assert len(got) == len(docs)


def test_edges(spark):
    loop = "to be or not " * 4
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, loop), (4, loop), (None, "a " * 20), (5, "é漢 \x0bé漢\x0c" * 12), (6, "x y " * 12), (7, "one two")]
    df = spark.createDataFrame([(i, t, "r", 1) for i, t in rows], "doc_id long, text string, runs string, k0 int")
    got = sorted(runs_of.periodic_runs(df, ["doc_id", "runs", "k0"]).collect(), key=repr)
    assert len(got) == len(rows) and [r["k0"] for r in got] == [1] * len(rows)
    out = runs_of.periodic_runs(df, ["doc_id"])
    assert out.columns == ["doc_id", "n_words", "runs", "collapsed"]
    for r, (i, t) in zip(out.collect(), rows):
        words = (t or "").encode().split()
        assert (r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]]) == (i, len(words), every_lag(words))
        assert r["collapsed"].encode() == (b" ".join(words) if not r["runs"] else b" ".join(words[: r["runs"][0]["period"]]))
    assert runs_of.periodic_runs(df.limit(0), ["doc_id"]).count() == 0
    with pytest.raises(Exception):
        runs_of.periodic_runs(df, ["missing"]).count()
