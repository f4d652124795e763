"""Whitening of embeddings: exact integer moments, eigenpairs by contour integration, projection.

Vectors become integers, so copies and sums are exact. The fit list holds each distinct vector once.
Its covariance is added up per task, centred; its leading eigenpairs come from
``spectrum.leading_eigenpairs``; every row is then projected where it lies, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.llm.common import scratch_table, table
from cohortlake.llm.spectrum import leading_eigenpairs

OFFSET = 1_000_000
REACH = float(1 << 52)  # entries whose scaled value reaches this have no integer of their own
WIDEST = 2048  # bounds the covariance on the driver to 32 MB
ROWS = 8192
WHITE_SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def integer_rows(rows: DataFrame, ident: str, vector: str, scale: float, offset: int) -> DataFrame:
    """(vec_id, x) with x = floor(scale * c) + offset; null, non-finite and out-of-reach entries drop the row."""
    value = F.col(vector)

    def good(c: Column) -> Column:
        wide = c.cast("double") * scale
        return c.isNotNull() & ~F.isnan(c) & (F.abs(wide) < REACH)

    valid = F.coalesce(value.isNotNull() & (F.size(value) > 0) & F.forall(value, good), F.lit(False))
    x = F.transform(value, lambda c: F.floor(c.cast("double") * scale).cast("long") + offset)
    return rows.filter(valid).select(F.col(ident).cast("long").alias("vec_id"), x.alias("x"))


def stacked(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def blocks(batches: Iterator[pa.RecordBatch], name: str, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The batches in slices of bounded size, each with its matrix of integers."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part, stacked(part.column(part.schema.get_field_index(name)), width)


@dataclass
class Moments:
    """Exact sums of the fit list, and how to centre a matrix of its integers."""

    n: int
    sums: list[int]

    @property
    def base(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], dtype=np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n: an exact integer difference, less the rest of the mean below 1."""
        rest = np.array([float(Fraction(s % self.n, self.n)) for s in self.sums])
        return (x - self.base).astype(float) - rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S)**2, exactly; null where a long cannot hold it."""
        rest = np.array([s % self.n for s in self.sums], dtype=np.int64)
        near = x - self.base
        most = (float(np.abs(near).max()) + 1) * self.n if near.size else 0.0
        if most * most * x.shape[1] < 2.0**62:
            return ((near * self.n - rest) ** 2).sum(axis=1).tolist()
        wide = near.astype(object) * self.n - rest.astype(object)
        return [int(v) if v < 1 << 63 else None for v in (wide * wide).sum(axis=1)]


def moments(fit: DataFrame, width: int) -> Moments:
    """Row count and sums per dimension, in two halves of 26 bits so that no task overflows."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low, n = np.zeros(width, dtype=np.int64), np.zeros(width, dtype=np.int64), 0
        for _, x in blocks(batches, "x", width):
            high += (x >> 26).sum(axis=0)
            low += (x & ((1 << 26) - 1)).sum(axis=0)
            n += len(x)
        yield pa.record_batch([pa.array(np.arange(width)), pa.array(high), pa.array(low), pa.array([n] * width)], names=["i", "high", "low", "n"])

    parts = fit.mapInArrow(add, "i long, high long, low long, n long").groupBy("i")
    rows = parts.agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low", "n")]).collect()
    sums = {r["i"]: (int(r["high"]) << 26) + int(r["low"]) for r in rows}
    return Moments(int(rows[0]["n"]), [sums[i] for i in range(width)])


def summed_products(rows: DataFrame, factors, width: int) -> np.ndarray:
    """The sum of z' z over all rows; ``factors`` makes the rows z of a batch. One partial matrix per task."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for z in factors(batches):
            total += z.T @ z
        i, j = np.tril_indices(width)
        yield pa.record_batch([pa.array(i), pa.array(j), pa.array(total[i, j])], names=["i", "j", "v"])

    cells = rows.mapInArrow(add, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros((width, width))
    i, j, v = (cells.column(c).to_numpy() for c in ("i", "j", "v"))
    out[i, j] = v
    out[j, i] = v
    return out


@dataclass
class Whitener:
    """A fitted whitening: moments, ``turn`` (vectors over roots of eigenvalues), shares and the check."""

    moments: Moments
    turn: np.ndarray
    explained: np.ndarray
    identity_error: float


def fit_whitener(fit: DataFrame, width: int, components: int) -> Whitener:
    """Fit on (x), distinct integer vectors of one width; every row takes part in every moment."""
    sums = moments(fit, width)

    def centred(batches):
        for _, x in blocks(batches, "x", width):
            yield sums.centred(x)

    covariance = summed_products(fit, centred, width) / sums.n
    values, vectors = leading_eigenpairs(fit.sparkSession, covariance, components)
    turn = vectors / np.sqrt(values)
    kept = len(values)

    def white(batches):
        for z in centred(batches):
            yield np.hstack([z @ turn, np.ones((len(z), 1))])

    error = 0.0
    if kept:
        check = summed_products(fit, white, kept + 1) / sums.n
        spread = check[:kept, :kept] - np.outer(check[kept, :kept], check[kept, :kept])
        error = float(np.abs(spread - np.eye(kept)).max())
    return Whitener(sums, turn, values / max(float(np.trace(covariance)), np.finfo(float).tiny), error)


def whitened(
    rows: DataFrame,
    components: int = 16,
    vector: str = "embedding",
    ident: str = "vec_id",
    scale: float = 64.0,
    offset: int = OFFSET,
) -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    x = floor(scale * c) + offset; the fit list is each distinct x once (n of them, sums S); the
    components are unit eigenvectors of its covariance, numbered from 1 by falling eigenvalue e.
    ``deviation`` is the sum of (n x - S)**2, exactly, null where a long cannot hold it; ``whitened``
    is x - S / n projected over sqrt(e); ``explained`` is e over the trace; ``identity_error`` is
    measured on the whitened fit list, in a pass of its own.

    Vectors that are null or empty, or hold a null, non-finite or (|scale * c| >= 2**52) unboundedly
    large entry, take no part. Nor do vectors of another width than the most frequent one among
    distinct vectors (ties to the greater). Rows with a null identifier and rows that repeat are all
    returned. Components whose eigenvalue is zero to rounding do not exist: there are fewer rows for
    narrow or flat tables, and none for an empty table or a single distinct vector. A cluster of equal
    eigenvalues gives some orthonormal basis of its space. Vectors wider than ``WIDEST`` are refused.
    """
    spark = rows.sparkSession
    good = integer_rows(rows, ident, vector, scale, offset)
    fit = scratch_table(good.select("x").distinct(), "fit")
    widths = fit.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    if widths is None:
        return spark.createDataFrame([], WHITE_SCHEMA)
    width = widths["width"]
    if width > WIDEST:
        raise ValueError(f"vectors of {width} entries; at most {WIDEST} are supported")
    model = fit_whitener(fit.filter(F.size("x") == width), width, components)
    kept = len(model.explained)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in blocks(batches, "x", width):
            n = len(x)
            yield pa.record_batch(
                [
                    part.column(0).take(pa.array(np.repeat(np.arange(n), kept))),
                    pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), n)),
                    pa.array(np.full(n * kept, model.moments.n, dtype=np.int64)),
                    pa.array(model.moments.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(n), kept))),
                    pa.array((model.moments.centred(x) @ model.turn).ravel()),
                    pa.array(np.tile(model.explained, n)),
                    pa.array(np.full(n * kept, model.identity_error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return good.filter(F.size("x") == width).mapInArrow(project, WHITE_SCHEMA)


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """The sixteen leading whitened components of every embedding."""
    return whitened(table(spark, folder, "embeddings"))
