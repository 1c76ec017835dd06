"""Reading detection tables and writing results, audit events and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

FORMATS = ("parquet", "orc", "json", "csv")


def load_table(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    tenant: object | None = None,
    columns: list[str] | None = None,
    schema: str | None = None,
    all_cores: bool = False,
) -> DataFrame:
    """Read a table, keeping one tenant's rows and only the named columns (both reach the scan).

    Timestamps without a zone are taken as UTC instants, which watermarks require.
    ``all_cores`` spreads the rows of a table whose files give fewer splits than there are
    cores, for CPU-heavy row work; a large table already has more splits and stays put.
    """
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}, not {fmt!r}")
    reader = spark.read.schema(schema) if schema else spark.read
    if fmt == "csv":
        reader = reader.option("header", True)
    df = reader.format(fmt).load(path)
    if tenant is not None:
        df = for_tenant(df, tenant)
    if columns:
        df = df.select(*columns)
    if all_cores:
        cores = spark.sparkContext.defaultParallelism
        if df.rdd.getNumPartitions() < cores:
            df = df.repartition(cores)
    return as_instants(df)


def as_instants(df: DataFrame) -> DataFrame:
    casts = {n: F.col(n).cast("timestamp") for n, t in df.dtypes if t == "timestamp_ntz"}
    return df.withColumns(casts) if casts else df


def for_tenant(df: DataFrame, tenant: object) -> DataFrame:
    """Tenant isolation: a plain equality, so it prunes partitions and row groups."""
    return df.where(F.col("tenant_id") == F.lit(tenant))


def write_results(df: DataFrame, path: str, mode: str = "append") -> None:
    """Append scans or findings, one folder per tenant.

    Rows are gathered by tenant and the result rebalanced: a large tenant is cut into as many
    tasks as its bytes need, and a small one gets one file.
    """
    df.hint("rebalance", "tenant_id").write.mode(mode).partitionBy("tenant_id").parquet(path)


def write_audit(df: DataFrame, path: str, at: str = "created_at") -> None:
    """Append audit events, one folder per calendar month, so time filters prune folders."""
    (
        df.withColumn("month", F.date_format(at, "yyyy-MM"))
        .write.mode("append").partitionBy("month").parquet(path)
    )


def read_audit(spark: SparkSession, path: str, since: str, until: str, at: str = "created_at") -> DataFrame:
    """Audit events in [since, until): the month folders are pruned before the time filter."""
    month = F.col("month").cast("string")
    return spark.read.parquet(path).where(
        (month >= since[:7]) & (month <= until[:7])
        & (F.col(at) >= F.lit(since).cast("timestamp")) & (F.col(at) < F.lit(until).cast("timestamp"))
    )


def export_columns(df: DataFrame, payload: str = "payload", fmt: str = "jsonl", max_chars: int | None = 500) -> DataFrame:
    """The payload fields only. CSV fields double their quotes, escape newlines and stop at ``max_chars``.

    500 characters is the published format; None keeps whole fields.
    """
    fields = df.select(f"{payload}.*")
    if fmt != "csv":
        return fields

    def as_csv(name: str, dtype: str) -> Column:
        text = F.col(name) if dtype == "string" else F.coalesce(F.to_json(F.col(name)) if dtype.startswith(("array", "struct", "map")) else F.col(name).cast("string"), F.lit('""'))
        escaped = F.replace(F.replace(text, F.lit('"'), F.lit('""')), F.lit("\n"), F.lit("\\n"))
        return (escaped if max_chars is None else F.substring(escaped, 1, max_chars)).alias(name)

    return fields.select(*[as_csv(n, t) for n, t in fields.dtypes])


def export_labelled(df: DataFrame, path: str, fmt: str = "jsonl", payload: str = "payload", max_chars: int | None = 500) -> None:
    """Write samples without their labels and detection metadata."""
    out = export_columns(df, payload, fmt, max_chars)
    if fmt == "csv":
        names = [F.concat(F.lit('"'), F.coalesce(F.col(c), F.lit("")), F.lit('"')) for c in out.columns]
        out.select(F.concat_ws(",", *names).alias("value")).write.mode("append").text(path)
    elif fmt in ("json", "jsonl"):
        out.write.mode("append").json(path)
    else:
        raise ValueError(f"cannot export as {fmt!r}")
