"""Streaming sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkpoison.session import shared_dir
from sparkpoison.sources.tables import as_instants

# --- fixed values: message topics
TOPICS = {"requests": "scan-requests", "results": "scan-results", "audit": "audit-events"}


def file_stream(spark: SparkSession, path: str, schema, glob: str | None = None, max_files: int | None = None) -> DataFrame:
    """New parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return as_instants(reader.parquet(path))


def kafka_stream(spark: SparkSession, servers: str, topic: str, schema: str, max_offsets: int | None = None) -> DataFrame:
    """JSON messages of a topic as typed rows (needs the Kafka connector on the class path)."""
    reader = (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
        .option("subscribe", TOPICS.get(topic, topic)).option("startingOffsets", "earliest")
    )
    if max_offsets:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    body = F.from_json(F.col("value").cast("string"), schema)
    return reader.load().select(body.alias("r"), F.col("timestamp").alias("received_at")).select("r.*", "received_at")


def kafka_sink(stream: DataFrame, servers: str, topic: str, checkpoint: str):
    """Write rows as JSON messages."""
    out = stream.select(F.to_json(F.struct("*")).alias("value"))
    return (
        out.writeStream.format("kafka").option("kafka.bootstrap.servers", servers)
        .option("topic", TOPICS.get(topic, topic)).option("checkpointLocation", checkpoint).start()
    )


def run_available(stream: DataFrame, mode: str = "append", path: str | None = None) -> DataFrame:
    """Process everything that is there, then read back what was written.

    ``append`` goes through the exactly-once file sink; ``complete`` rewrites one folder per batch,
    so a repeated batch replaces its own output.
    """
    spark = stream.sparkSession
    base = path or f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", f"{base}/out").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{base}/out")
    last: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/{number}")
        last[:] = [number]

    writer.foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out/{last[0]}")
