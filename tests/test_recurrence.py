"""Copy recurrence by buckets of hashes, against counting the shingles themselves."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from sparkpoison.functions import shingles as sh
from sparkpoison.operators import text as tx
from sparkpoison.plans.registry import load


def counted(rows, words=8):
    own = []
    for i, t in rows:
        w = [x for x in re.split("[ \t\n\f\r]+", (t or "").lower()) if x]
        if w:
            own.append((i, {tuple(w[k : k + words]) for k in range(max(len(w) - words + 1, 1))}))
    seen = Counter(s for _, held in own for s in held)
    return {(i, len(h), sum(seen[s] > 1 for s in h), max(seen[s] for s in h), round(sum(seen[s] > 1 for s in h) / len(h), 6)) for i, h in own}


def texts(n):
    rng = random.Random(5)
    line = "this one line stands in very many of all the texts here"
    made = [" ".join(rng.choice(["a", "B", "é", "漢字", "x.y", " ", "\x0b", "word"]) for _ in range(rng.randint(0, 30))) for _ in range(n)]
    return [None, "", " \n\t", "one", "One\n", "a b c d e f g", "a b c d e f g h", "a\tb c\r\nd e f g h", "z " * 500, *(f"{t}\n{line}" if k % 2 else t for k, t in enumerate(made)), *made[:9]]


@pytest.mark.parametrize("frequent", [2, 5, 1000])
def test_recurrence_of_odd_texts(spark, frequent, monkeypatch):
    monkeypatch.setattr(tx, "_BUCKET_BYTES", 200)
    ids = [None, -(2**40), 2**62, *range(10**6, 10**6 + 2000, 7)]
    rows = list(zip(ids, texts(200)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {tuple(r) for r in tx.copy_recurrence(df, frequent=frequent).collect()} == counted(rows)
    named = [(f"n{i}" if i else None, t) for i, t in rows]
    df = spark.createDataFrame(named, "doc_id string, text string").repartition(3)
    assert {tuple(r) for r in tx.copy_recurrence(df, 3, frequent=frequent).collect()} == counted(named, 3)
    assert tx.copy_recurrence(df.limit(0)).count() == 0


def test_words_end_where_the_sql_has_it(spark, tmp_path):
    """A vertical tab is white space to Java's patterns and not to the SQL's."""
    rows = [(1, "a\x0bb c"), (2, "a b c"), (3, "A\x0bB\fc"), (4, "a b\x85c"), (5, "a b c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.coalesce(1).write.parquet(f"{tmp_path}/documents")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    want = con.execute(load()["text_copy_recurrence"].check).fetchall()
    assert sorted(map(tuple, tx.copy_recurrence(df).collect())) == sorted(want)


def test_no_shingle_is_a_row(spark):
    df = spark.createDataFrame([(i, f"{' '.join(f'w{i * k % 97}' for k in range(300))}") for i in range(200)], "doc_id long, text string").coalesce(1)
    out = tx.copy_recurrence(df)
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
    dealt = df.selectExpr("doc_id AS id", "text").mapInArrow(lambda b: sh.deal(b, 8, 16, 64), sh.ROW)
    shingles = out.selectExpr("sum(shingles)").first()[0]
    assert shingles > 10_000 and dealt.count() <= 2 * 16


def test_hashes_alike_in_part_are_told_apart():
    def row(hashes, checks, ids):
        return 0, sh.ITEMS, 0, 8, np.array(ids, "<i8").tobytes(), np.array(hashes, "<u8").tobytes(), bytes(checks)

    rows = [row([7, 7, 9], [1, 2, 1], [10, 11, 12]), row([7, 5], [1, 1], [13, 14])]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    names = [c.split()[0] for c in sh.ROW.split(", ")]
    out = sh.count(pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds))}))
    assert np.frombuffer(out["ids"][0].as_py(), "<i8").tolist() == [10, 13] and np.frombuffer(out["amounts"][0].as_py(), "<i8").tolist() == [2, 2]
