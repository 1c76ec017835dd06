"""Vector expressions. Arrow batches keep the per-element work in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType


def _matrix(column: pa.Array) -> np.ndarray | None:
    """A list column as an n×d double matrix, or None when lengths differ or rows are null."""
    if len(column) == 0 or column.null_count:
        return None
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = np.diff(column.offsets.to_numpy())
    if lengths[0] == 0 or np.any(lengths != lengths[0]):
        return None
    return flat.reshape(len(column), lengths[0])


@F.arrow_udf(DoubleType())
def _dot(left: pa.Array, right: pa.Array) -> pa.Array:
    a, b = _matrix(left), _matrix(right)
    if a is not None and b is not None and a.shape == b.shape:
        return pa.array(np.einsum("ij,ij->i", a, b))
    rows = []
    for x, y in zip(left.to_pylist(), right.to_pylist()):
        same = x is not None and y is not None and len(x) == len(y)
        rows.append(float(np.dot(np.asarray(x, float), np.asarray(y, float))) if same else None)
    return pa.array(rows, pa.float64())


def dot(left: Column | str, right: Column | str) -> Column:
    """Inner product; null when the lengths differ."""
    return _dot(left, right)


def norm(vector: Column | str) -> Column:
    return F.sqrt(_dot(vector, vector))


def cosine(left: Column | str, right: Column | str, floor: float | None = None) -> Column:
    """Cosine similarity. A zero norm gives 0, or is replaced by ``floor`` when given."""
    na, nb = norm(left), norm(right)
    if floor is not None:
        na, nb = F.greatest(na, F.lit(floor)), F.greatest(nb, F.lit(floor))
        return dot(left, right) / (na * nb)
    return F.when((na > 0) & (nb > 0), dot(left, right) / (na * nb)).otherwise(0.0)
