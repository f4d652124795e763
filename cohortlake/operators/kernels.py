"""Kernel evaluations of many rows against a bounded reference set, and their centring.

The row side is never paired inside Spark: each Arrow batch of rows is multiplied with the
reference matrix, and one array of kernel values per row comes out. How many reference rows there
may be is an argument; a larger set is refused, never computed in another way.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlake.functions.vector import list_array, matrix_of

Kernel = Callable[[np.ndarray, np.ndarray], np.ndarray]

# Most reference rows by default. The broadcast matrix and the square matrix that centring and
# landmark features build on the driver (32 MB) follow from this number alone.
MOST_REFERENCES = 2048
# Kernel values (float64) that a task holds at a time, whatever the size of its Arrow batch.
_CELLS = 1 << 22


# --- kernel functions on row blocks ---------------------------------------------------------


def linear(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return x @ y.T


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    def unit(m: np.ndarray) -> np.ndarray:
        return m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-9)

    return unit(x) @ unit(y).T


def rbf(gamma: float) -> Kernel:
    return partial(_rbf, gamma=gamma)


def _rbf(x: np.ndarray, y: np.ndarray, gamma: float) -> np.ndarray:
    square = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T
    return np.exp(-gamma * np.maximum(square, 0))


def fidelity(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared overlap of the directions of two vectors."""
    return cosine(x, y) ** 2


def angles(scale: float) -> Kernel:
    """Mean cosine of the scaled entry differences: the product of ``angle_columns``."""
    return partial(_angles, scale=scale)


def _angles(x: np.ndarray, y: np.ndarray, scale: float) -> np.ndarray:
    x, y = x * scale, y * scale
    return (np.cos(x) @ np.cos(y).T + np.sin(x) @ np.sin(y).T) / max(1, x.shape[1])


def angle_columns(vector: Column, scale: float = 1.0) -> tuple[Column, Column]:
    """Each entry as a point on the unit circle, (cosine, sine) arrays of the vector's own width."""
    turned = F.transform(vector.cast("array<double>"), lambda v: v * F.lit(scale))
    return F.transform(turned, lambda v: F.cos(v)), F.transform(turned, lambda v: F.sin(v))


# --- reference sets -------------------------------------------------------------------------


@dataclass(frozen=True)
class ReferenceSet:
    ids: list
    matrix: np.ndarray


def reference_set(df: DataFrame, ident: str, vector: str, most: int = MOST_REFERENCES) -> ReferenceSet:
    """Collect the reference rows, in the order of their identifiers; more than ``most`` are an error."""
    rows = df.select(ident, F.col(vector).cast("array<double>").alias("v")).limit(most + 1).toArrow()
    if rows.num_rows == 0:
        raise ValueError("the reference set is empty")
    if rows.num_rows > most:
        raise ValueError(f"more than {most} reference rows; draw a sample or raise the number allowed")
    rows = rows.sort_by(ident)
    return ReferenceSet(rows.column(0).to_pylist(), matrix_of(rows.column(1).combine_chunks()))


def by_parts(evaluate: Callable[[np.ndarray], np.ndarray], vectors: pa.Array, width: int) -> pa.Array:
    """``evaluate`` on parts of an Arrow batch, so that wide results keep within a task's memory."""
    if len(vectors) == 0:
        return pa.array([], pa.list_(pa.float64()))
    step = max(1, _CELLS // max(1, width))
    parts = [list_array(evaluate(matrix_of(vectors.slice(at, step)))) for at in range(0, len(vectors), step)]
    return pa.concat_arrays(parts)


def kernel_column(
    df: DataFrame, vector: Column, refs: ReferenceSet, kernel: Kernel, centred: bool = False
) -> Column:
    """``array<double>`` of kernel values against the reference rows, in reference order.

    ``centred`` treats the reference rows as the training rows: their column means and overall mean
    and the row's own mean are taken off inside the array, so nothing is shuffled.
    """
    means, overall = np.zeros(len(refs.ids)), 0.0
    if centred:
        square = kernel(refs.matrix, refs.matrix)
        means, overall = square.mean(axis=0), float(square.mean())
    shared = df.sparkSession.sparkContext.broadcast((refs.matrix, means))

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def evaluate(vectors: pa.Array) -> pa.Array:
        matrix, columns = shared.value

        def values(x: np.ndarray) -> np.ndarray:
            k = kernel(x, matrix)
            return k - k.mean(axis=1, keepdims=True) - columns + overall if centred else k

        return by_parts(values, vectors, len(matrix))

    return evaluate(vector.cast("array<double>"))


def kernel_against(
    rows: DataFrame,
    refs: DataFrame,
    ident: str,
    vector: str,
    kernel: Kernel,
    most: int = MOST_REFERENCES,
    centred: bool = False,
) -> DataFrame:
    """Long ``(ident, ref_id, k)`` of all rows against at most ``most`` reference rows."""
    known = reference_set(refs, ident, vector, most)
    values = kernel_column(rows, F.col(vector), known, kernel, centred)
    kind = dict(refs.dtypes)[ident]
    names = rows.sparkSession.createDataFrame(list(enumerate(known.ids)), f"__position int, ref_id {kind}")
    placed = rows.select(ident, F.posexplode(values).alias("__position", "k"))
    # At most ``most`` names, which bounds the broadcast.
    return placed.join(F.broadcast(names), "__position").select(ident, "ref_id", "k")


# --- centring -------------------------------------------------------------------------------


def centre_training(kernel: DataFrame, row: str, column: str, value: str = "k") -> DataFrame:
    """``k - row mean - column mean + overall mean`` of a square training kernel in long form."""
    overall = kernel.agg(F.avg(value)).scalar()
    rows, columns = Window.partitionBy(row), Window.partitionBy(column)
    centred = F.col(value) - F.avg(value).over(rows) - F.avg(value).over(columns) + overall
    return kernel.select(row, column, centred.alias(value))


def centre_against(kernel: DataFrame, refs: DataFrame, row: str, column: str = "ref_id", value: str = "k") -> DataFrame:
    """Centre a long kernel of any rows against reference rows, which are the training rows.

    The row's own mean and the column means over the training rows go, their overall mean is added.
    ``refs`` holds the reference rows' identifiers in ``row``; there are few columns, many rows.
    """
    training = kernel.join(refs.select(row).distinct(), row, "left_semi")
    means = training.groupBy(column).agg(F.avg(value).alias("__mean"))
    overall = training.agg(F.avg(value)).scalar()
    centred = F.col(value) - F.avg(value).over(Window.partitionBy(row)) - F.col("__mean") + overall
    return kernel.join(means, column).select(row, column, centred.alias(value))


# --- explicit features of a kernel ----------------------------------------------------------


@dataclass(frozen=True)
class KernelFeatures:
    """Landmark features whose inner product is the (centred) kernel.

    With all training rows as landmarks the product equals the training kernel exactly; with fewer
    it is the usual low-rank approximation. A linear model on these features is the kernel model.
    """

    landmarks: np.ndarray
    column_means: np.ndarray
    overall: float
    basis: np.ndarray
    centred: bool

    @staticmethod
    def fit(landmarks: np.ndarray, kernel: Kernel, centred: bool, floor: float = 1e-10) -> KernelFeatures:
        gram = kernel(landmarks, landmarks)
        means, overall = gram.mean(axis=0), float(gram.mean())
        if centred:
            gram = gram - means[None, :] - means[:, None] + overall
        values, vectors = np.linalg.eigh((gram + gram.T) / 2)
        keep = values > floor * max(values[-1], 1e-300)
        return KernelFeatures(landmarks, means, overall, vectors[:, keep] / np.sqrt(values[keep]), centred)


def kernel_features_column(df: DataFrame, vector: Column, fitted: KernelFeatures, kernel: Kernel) -> Column:
    shared = df.sparkSession.sparkContext.broadcast((fitted.landmarks, fitted.column_means, fitted.basis))
    centred, overall = fitted.centred, fitted.overall

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def features(vectors: pa.Array) -> pa.Array:
        landmarks, means, basis = shared.value

        def values(x: np.ndarray) -> np.ndarray:
            k = kernel(x, landmarks)
            if centred:
                k = k - k.mean(axis=1, keepdims=True) - means[None, :] + overall
            return np.ascontiguousarray(k @ basis)

        return by_parts(values, vectors, len(landmarks))

    return features(vector.cast("array<double>"))


def scale_gamma(moments: dict) -> float:
    """``1 / (width * variance over all cells)`` from per-feature moments."""
    means, stds = np.array(moments["means"]), np.array(moments["stds"])
    variance = float((stds**2 + means**2).mean() - means.mean() ** 2)
    return 1.0 / (len(means) * variance) if variance > 0 else 1.0

