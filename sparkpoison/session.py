"""Session defaults and the few helpers that touch the session itself."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Bytes a side may have, as measured on its rows, before it is no longer broadcast.
BROADCAST_BYTES = 32 << 20

#: Spark's own setting (4.1): an execution's shuffle files go with its end
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "sparkpoison", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator assumes (UTC, AQE, no case surprises)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


#: folders of local sessions; they go when the process ends
_made: list[tempfile.TemporaryDirectory] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, taken from ``spark.checkpoint.dir``.

    Only a local master (tests) gets a folder made for it; a cluster without the
    setting is an error, because a folder on one machine would be lost with it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    _made.append(tempfile.TemporaryDirectory(prefix="sparkpoison-", ignore_cleanup_errors=True))
    spark.sparkContext.setCheckpointDir(_made[-1].name)
    return _made[-1].name


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of an iterative job with a reliable checkpoint."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder, read back: cuts the lineage like ``checkpoint``, and the size is the table's own.

    A checkpoint keeps the planner's estimate, which a join squares; where the same table is joined round after round
    the estimate outgrows the time for planning. Remove the table with ``discard`` when nothing reads it any more.
    Rows are computed once, where a checkpoint computes its last stage twice, and the files of the write's shuffles go at once,
    not when the driver next collects its garbage. A table that a result still reads goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Remove the files of a ``stored`` table."""
    spark = table.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _width(name: str, kind: str) -> Column:
    """About the bytes of a column's value."""
    if kind == "string" or kind == "binary":
        return F.coalesce(F.octet_length(name), F.lit(0))
    if kind in ("array<double>", "array<float>", "array<bigint>", "array<int>"):
        return F.lit(8) * F.greatest(F.coalesce(F.size(name), F.lit(0)), F.lit(0))
    if kind.startswith(("array", "map", "struct")):
        return F.coalesce(F.octet_length(F.to_json(F.array(name) if kind.startswith("struct") else name)), F.lit(0))
    return F.lit(8)


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint only after measuring all rows; a larger side is left to a shuffle join."""
    row = sum((_width(name, kind) for name, kind in df.dtypes), F.lit(16))
    measured = df.agg(F.sum(row.cast("bigint"))).first()[0] or 0
    return F.broadcast(df) if measured <= max_bytes else df
