"""Column expressions on ``array<double>`` vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(vector: Column) -> Column:
    return vector.cast("array<double>")


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(vector), F.lit(0.0), lambda s, x: s + x * x))


def l2_normalized(vector: Column, guard: float = 1e-9) -> Column:
    """Divide by ``norm + guard``; the guard keeps an all-zero vector at zero.

    The divisor enters as a repeated array, so it is evaluated once per row and not inside the
    lambda once per entry.
    """
    size = F.array_repeat(norm(vector) + F.lit(guard), F.size(vector))
    return F.zip_with(as_double(vector), size, lambda x, s: x / s)


def first_features(vector: Column, cap: int | None) -> Column:
    """Keep the first ``cap`` entries when ``0 < cap``; other values keep the whole vector."""
    return F.slice(vector, 1, cap) if cap and cap > 0 else vector


def scaled(vector: Column, factor: float) -> Column:
    return F.transform(as_double(vector), lambda x: x * F.lit(float(factor)))


def list_array(matrix: np.ndarray) -> pa.Array:
    """Rows of a matrix as an Arrow list column."""
    rows, width = matrix.shape
    return pa.ListArray.from_arrays(np.arange(rows + 1, dtype=np.int32) * width, pa.array(matrix.ravel()))


def matrix_of(column: pa.Array) -> np.ndarray:
    """Arrow list column as a float64 matrix; null vectors and vectors of unequal width are errors."""
    if column.null_count:
        raise ValueError(f"{column.null_count} of {len(column)} vectors are null; filter them first")
    if len(column) == 0:
        return np.zeros((0, 0))
    widths = np.diff(column.offsets.to_numpy())
    if widths.min() != widths.max():
        raise ValueError(f"vectors of different widths in one column: {widths.min()} and {widths.max()}")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), int(widths[0]))
