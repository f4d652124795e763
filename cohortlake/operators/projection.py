"""Fitted linear maps on feature vectors: scaling, feature choice, principal components."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlake.functions.vector import list_array, matrix_of
from cohortlake.operators.features import vector_moments

_DOUBLES = T.ArrayType(T.DoubleType())


def _inverse(stds: Sequence[float]) -> np.ndarray:
    s = np.asarray(stds, dtype=float)
    return 1.0 / np.where(s == 0, 1.0, s)


@dataclass(frozen=True)
class Scaling:
    """Standardise a vector and keep the chosen positions."""

    means: list[float]
    stds: list[float]
    keep: list[int]

    def column(self, vector: Column) -> Column:
        keep = np.array(self.keep, dtype=int)
        means, inverse = np.array(self.means)[keep], _inverse(self.stds)[keep]

        @F.arrow_udf(_DOUBLES)
        def scale(vectors: pa.Array) -> pa.Array:
            if len(vectors) == 0:
                return pa.array([], pa.list_(pa.float64()))
            return list_array((matrix_of(vectors)[:, keep] - means) * inverse)

        return scale(vector.cast("array<double>"))


def fit_scaling(df: DataFrame, vector: str, keep: Sequence[int] | None = None) -> Scaling:
    moments = vector_moments(df, vector)
    positions = list(range(len(moments["means"]))) if keep is None else list(keep)
    return Scaling(moments["means"], moments["stds"], positions)


def log_ratio_column(vector: Column, positions: Sequence[int], pseudocount: float) -> Column:
    """Centred log-ratio of the given vector positions, jointly; other positions stay."""
    if not positions:
        return vector.cast("array<double>")
    chosen = np.array(positions, dtype=int)

    @F.arrow_udf(_DOUBLES)
    def transform(vectors: pa.Array) -> pa.Array:
        if len(vectors) == 0:
            return pa.array([], pa.list_(pa.float64()))
        x = matrix_of(vectors).copy()
        logs = np.log(x[:, chosen] + pseudocount)
        x[:, chosen] = logs - logs.mean(axis=1, keepdims=True)
        return list_array(x)

    return transform(vector.cast("array<double>"))


@dataclass(frozen=True)
class Components:
    """Standardisation followed by a projection on principal components.

    The sign of a component is fixed by making its largest loading positive.
    """

    means: list[float]
    stds: list[float]
    axes: list[list[float]]
    explained: list[float]

    def column(self, vector: Column) -> Column:
        means, inverse, axes = np.array(self.means), _inverse(self.stds), np.array(self.axes).T

        @F.arrow_udf(_DOUBLES)
        def project(vectors: pa.Array) -> pa.Array:
            if len(vectors) == 0:
                return pa.array([], pa.list_(pa.float64()))
            return list_array(((matrix_of(vectors) - means) * inverse) @ axes)

        return project(vector.cast("array<double>"))


def fit_components(df: DataFrame, vector: str, k: int) -> Components:
    """Fit on standardised rows; ``k`` is clamped to the vector width."""
    scaling = fit_scaling(df, vector)
    k = min(k, len(scaling.means))
    rows = df.select(array_to_vector(scaling.column(F.col(vector))).alias("v"))
    model = PCA(k=k, inputCol="v", outputCol="p").fit(rows)
    axes = model.pc.toArray().T
    signs = np.sign(axes[np.arange(k), np.abs(axes).argmax(axis=1)])
    axes = axes * np.where(signs == 0, 1.0, signs)[:, None]
    return Components(scaling.means, scaling.stds, axes.tolist(), model.explainedVariance.toArray().tolist())
