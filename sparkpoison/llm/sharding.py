"""Sharding: contiguous shards of nearly equal bytes from a global prefix sum of sizes.

Documents are put in the order of their text's checksum, so equal texts stand together;
every range partition reports its bytes and rows, the totals of the partitions before it
are its offset, and a document goes to the shard in whose byte range its middle lies. Only
(id, size, checksum) rows move, never texts, and a third of all rows with one text is
divided among range partitions by their ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkpoison.llm.common import map_texts, read, text_bytes
from sparkpoison.session import checkpoint


def assign_shards(docs: DataFrame, shards: int = 40, overhead: int = 16, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row.

    ``size`` is the text's UTF-8 bytes plus ``overhead``; a null text has no bytes and checksum 0, as the empty one.
    Law ``bytes``: every shard holds total / shards bytes give or take one document; ``slot`` counts a shard's
    documents from 0 without gaps in the order of (checksum, id). Equal rows are interchangeable, null ids come
    first among equal texts, an empty table gives an empty result. ``grown_shard`` is null: with one more shard the
    cuts move. Other columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType

    def sizes():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = text_bytes(batch.column(1))
            size = np.array([len(t) for t in texts], np.int64) + overhead
            crc = np.array([zlib.crc32(t) for t in texts], np.int64)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(crc)], ["doc_id", "size", "text_crc32"])

        return step

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    small = map_texts(rows, "text", f"doc_id {kind.simpleString()}, size long, text_crc32 long", sizes)
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    keys = ["text_crc32", "doc_id", "size"]
    # Written once: the totals and the prefix sums must see the same partitions in the same order.
    ranged = small.repartitionByRange(int(parts), *keys).sortWithinPartitions(*keys)
    ranged = checkpoint(ranged.withColumn("part", F.spark_partition_id()))

    before = _offsets(ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")))
    total = sum(b for _, b, _ in before.values())
    starts = {p: (at_bytes, at_rows) for p, (at_bytes, _, at_rows) in before.items()}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, tuple[int, int]] = {}
        for batch in batches:
            part = batch.column(3).to_numpy()
            for p in np.unique(part):  # one, unless a task reads several partitions one after the other
                rows = batch.filter(pa.array(part == p))
                at, n = seen.get(p, starts[int(p)])
                size = rows.column(1).to_numpy()
                ends = at + np.cumsum(size)
                middle = 2 * (ends - size) + size  # twice the middle
                shard = np.minimum(middle * shards // (2 * max(total, 1)), shards - 1)
                place = n + np.arange(len(size))
                seen[p] = (int(ends[-1]), int(place[-1]) + 1)
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns[:3], pa.array(shard, pa.int32()), pa.array(place, pa.int64())],
                    ["doc_id", "size", "text_crc32", "shard", "place"],
                )

    placed = ranged.mapInArrow(cut, f"doc_id {kind.simpleString()}, size long, text_crc32 long, shard int, place long")
    first = placed.groupBy("shard").agg(F.min("place").alias("first")).collect()  # a row per shard
    at = F.create_map(*[F.lit(x) for r in first for x in (r["shard"], r["first"])]) if first else F.create_map(F.lit(0), F.lit(0))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("place") - at[F.col("shard")]).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def _offsets(totals: DataFrame) -> dict[int, tuple[int, int, int]]:
    """{partition: (bytes before, own bytes, rows before)}; one row per partition comes to the driver."""
    out, at, n = {}, 0, 0
    for r in sorted(totals.collect(), key=lambda r: r["part"]):
        out[r["part"]] = (at, r["bytes"], n)
        at, n = at + r["bytes"], n + r["rows"]
    return out


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of equal bytes."""
    return assign_shards(read(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES = {"op10_sharding": op10_sharding}
#: DuckDB has no CRC-32; tests/llm compares with plain Python.
ORACLE_SQL: dict[str, str] = {}
