"""Helpers the operators share: reading tables, Arrow passes over texts, byte-level tokens."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: rows and bytes of one Arrow batch handed to Python; a longer single text is a batch of its own
BATCH_ROWS = 1024
BATCH_BYTES = 8 << 20


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """A table of the test data, only the named columns."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session's Python stages by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each value; null counts as empty."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


def in_pieces(batch: pa.RecordBatch, text: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text, at least one row each."""
    column = batch.column(batch.schema.get_field_index(text))
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0))
    ends = np.cumsum(sizes)
    lo = 0
    while lo < batch.num_rows:
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def map_texts(df: DataFrame, text: str, schema: str, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]]) -> DataFrame:
    """``make()`` once per task, then its result on slices of bounded size."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for piece in in_pieces(batch, text):
                out = step(piece)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def map_cells(df: DataFrame, cell: list[str], schema: str, solve: Callable[[pa.Table], pa.RecordBatch], several: bool = False) -> DataFrame:
    """``solve`` on the rows of each value of the whole-number columns ``cell``, which must be bounded groups.

    Cells lie one behind the other in a task, so many small ones share a batch and none is gathered with others.
    With ``several``, ``solve`` gets the whole cells that an Arrow batch completes at once, not one at a time.
    """
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            at = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in cell])
            cuts = [0, *(np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1), batch.num_rows]
            if several and len(cuts) > 2:  # the last cell may go on in the next batch
                if held and tuple(at[:, 0]) != last:
                    yield solve(pa.Table.from_batches(held))
                    held = []
                yield solve(pa.Table.from_batches([*held, batch.slice(0, cuts[-2])]))
                held, last, cuts = [], None, cuts[-2:]
            for lo, hi in zip(cuts, cuts[1:]):
                here = tuple(at[:, lo])
                if held and here != last:
                    yield solve(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(lo, hi - lo))
                last = here
        if held:
            yield solve(pa.Table.from_batches(held))

    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks, *cell).sortWithinPartitions(*cell).mapInArrow(run, schema)
