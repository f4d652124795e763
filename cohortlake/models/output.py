"""Fitted linear outputs, and the cached rows that iterative fits read."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import DenseMatrix, DenseVector, Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.functions.vector import as_double, list_array, matrix_of

# Feature bytes one training partition should hold at least.
_PARTITION_BYTES = 32 << 20


@dataclass(frozen=True)
class LinearModel:
    """Weights and intercepts of one output (class 1 against class 0) or one output per class.

    ``link`` says what outputs mean: logistic and softmax have probabilities, margin has none.
    """

    weights: list[list[float]]
    intercepts: list[float]
    link: str = "margin"

    @property
    def coefficients(self) -> DenseVector:
        return Vectors.dense(self.weights[0])

    @property
    def coefficientMatrix(self) -> DenseMatrix:
        matrix = np.array(self.weights, dtype=float)
        return DenseMatrix(*matrix.shape, matrix.ravel(), isTransposed=True)

    @property
    def intercept(self) -> float:
        return self.intercepts[0]

    def outputs(self, vector: Column) -> Column:
        """One value per class: probabilities, or margins of which the greatest wins."""
        slopes, shifts, link = np.array(self.weights, dtype=float).T, np.array(self.intercepts, dtype=float), self.link

        @F.arrow_udf("array<double>")
        def product(vectors: pa.Array) -> pa.Array:
            if len(vectors) == 0:
                return pa.array([], pa.list_(pa.float64()))
            z = matrix_of(vectors) @ slopes + shifts
            if link == "softmax":
                z = np.exp(z - z.max(axis=1, keepdims=True))
                z /= z.sum(axis=1, keepdims=True)
            elif link == "logistic":
                p = np.exp(-np.logaddexp(0.0, -z))
                z = np.hstack([np.exp(-np.logaddexp(0.0, z)), p])
            elif z.shape[1] == 1:
                z = np.hstack([-z, z])
            return list_array(z)

        return product(as_double(vector))

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, self.link, b, w) for i, (w, b) in enumerate(zip(self.weights, self.intercepts, strict=True))]
        return spark.createDataFrame(rows, "output int, link string, intercept double, weights array<double>")

    @staticmethod
    def of(table: DataFrame) -> LinearModel:
        rows = table.orderBy("output").collect()
        return LinearModel([list(r["weights"]) for r in rows], [r["intercept"] for r in rows], rows[0]["link"])


def index_of_greatest(outputs: Column) -> Column:
    """0-based index of the greatest entry; the first one wins ties."""
    return (F.array_position(outputs, F.array_max(outputs)) - 1).cast("int")


@contextmanager
def training_rows(rows: DataFrame, width: int) -> Iterator[tuple[DataFrame, float, int]]:
    """Cached rows in as few partitions as their size needs, their total weight, and how many those are.

    An iterative fit runs one job per step, so its cost on little data is the number of tasks. The
    rows are computed once in parallel; only their cached copy is read with fewer tasks. Data larger
    than one partition's share keeps its partitions.
    """
    cached = rows.persist()
    try:
        facts = cached.agg(F.sum("__w").alias("w"), F.count(F.lit(1)).alias("n")).first()
        if not facts["n"]:
            raise ValueError("no rows to train on")
        parts = max(1, -(-facts["n"] * max(width, 1) * 8 // _PARTITION_BYTES))
        yield cached.coalesce(parts), facts["w"], parts
    finally:
        cached.unpersist()
