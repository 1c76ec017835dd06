import brute

from sparkpoison.llm import sharding


def key(row):
    return tuple(repr(x) for x in row)


def check(got, rows):
    out = [(r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in got]
    assert sorted(out, key=key) == sorted(brute.shards(rows), key=key)
    assert all(r["law"] == "bytes" and r["grown_shard"] is None for r in got)


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = sharding.op10_sharding(spark, sf_dir).collect()
    check(got, [tuple(r) for r in docs])
    sizes = {}
    for r in got:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r["size"] for r in got)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "é" * 5000), (3, "é" * 5000), (None, "x")] + [(10 + i, "same text") for i in range(300)] + [(9, "ab")] * 3
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, size int, shard int")
    check(sharding.assign_shards(df).collect(), rows)
    assert sharding.assign_shards(df.limit(0)).count() == 0
    one = spark.createDataFrame([(None, None)], "doc_id long, text string")
    assert [(r["shard"], r["slot"]) for r in sharding.assign_shards(one).collect()] == [(20, 0)]
