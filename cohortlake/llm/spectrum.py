"""Leading eigenpairs of a covariance by contour integration, one task per eigenvalue interval.

Inertia counts of the shifted matrix place the intervals; each interval's invariant subspace is
filtered by quadrature of complex shifted solves on a circle around it (FEAST), and Rayleigh-Ritz
extracts its eigenvectors. The inertia of an interval says how many there must be.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

NODES = 8  # quadrature nodes on the upper half circle
CROWD = 4  # eigenvalues that an interval aims at
PAIR_SCHEMA = "number int, value double, vector array<double>"


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of a similar tridiagonal matrix, by Householder reflections."""
    a = np.array(matrix, dtype=float)
    n = len(a)
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        x[0] += np.copysign(np.linalg.norm(x), x[0])
        norm = np.linalg.norm(x)
        if norm == 0:
            continue
        v = x / norm
        part = a[k + 1 :, k + 1 :]
        p = part @ v
        p -= v * (v @ p)
        part -= 2 * (np.outer(v, p) + np.outer(p, v))
        a[k + 1, k] = -np.copysign(norm_of(a[k + 1 :, k]), a[k + 1, k])
        a[k + 2 :, k] = 0
    return np.diagonal(a).copy(), np.diagonal(a, -1).copy()


def norm_of(x: np.ndarray) -> float:
    return float(np.linalg.norm(x))


def count_above(diagonal: np.ndarray, off: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """How many eigenvalues exceed each shift: positive pivots of the shifted matrix's LDL' (inertia)."""
    shifts = np.asarray(shifts, dtype=float)
    tiny = np.finfo(float).tiny
    count = np.zeros(len(shifts), dtype=int)
    pivot = np.ones(len(shifts))
    for k, d in enumerate(diagonal):
        pivot = d - shifts - (off[k - 1] ** 2 / pivot if k else 0.0)
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        count += pivot > 0
    return count


def located(diagonal: np.ndarray, off: np.ndarray, wanted: int) -> np.ndarray:
    """The ``wanted`` greatest eigenvalues, falling, to about nine digits of the greatest: bisection by inertia."""
    radius = np.abs(np.r_[0.0, off]) + np.abs(np.r_[off, 0.0])
    low, high = float((diagonal - radius).min()), float((diagonal + radius).max())
    rank = np.arange(1, wanted + 1)
    lows, highs = np.full(wanted, low), np.full(wanted, high)
    for _ in range(60):
        middle = (lows + highs) / 2
        above = count_above(diagonal, off, middle) >= rank
        lows, highs = np.where(above, middle, lows), np.where(above, highs, middle)
        if (highs - lows).max() <= 1e-10 * max(abs(low), abs(high)):
            break
    return (lows + highs) / 2


def intervals(matrix: np.ndarray, wanted: int) -> list[tuple[float, float, int]]:
    """(low, high, count) from the top that hold the ``wanted`` greatest eigenvalues at least.

    Bounds lie in the middle of gaps, so a cluster is never cut; an interval that would end in one
    goes on to the cluster's end. The counts are inertia counts at the bounds.
    """
    n = len(matrix)
    diagonal, off = tridiagonal(matrix)
    values = located(diagonal, off, n)
    top = max(abs(values[0]), abs(values[-1]))
    span = top * 1e-3 or 1.0
    cuts, start = [values[0] + span], 0
    for i in range(n):
        last = i == n - 1
        wide = last or values[i] - values[i + 1] > 1e-6 * top
        if wide and (i + 1 - start >= CROWD or i + 1 >= wanted):
            cuts.append(values[i] - span if last else (values[i] + values[i + 1]) / 2)
            start = i + 1
            if i + 1 >= wanted:
                break
    counts = count_above(diagonal, off, np.array(cuts))
    return [(low, high, int(b - a)) for low, high, a, b in zip(cuts[1:], cuts, counts, counts[1:], strict=False)]


def projected(matrix: np.ndarray, low: float, high: float, block: np.ndarray, nodes: int) -> np.ndarray:
    """Quadrature of the resolvent on the circle over [low, high], applied to ``block``.

    The matrix is real and symmetric, so the lower half circle adds the conjugate of the upper one.
    """
    centre, radius = (low + high) / 2, (high - low) / 2
    out = np.zeros_like(block)
    unit = np.eye(len(matrix))
    for angle in (np.arange(nodes) + 0.5) * np.pi / nodes:
        turn = np.exp(1j * angle)
        out += np.real(radius * turn / nodes * np.linalg.solve((centre + radius * turn) * unit - matrix, block))
    return out


def eigenpairs_within(matrix: np.ndarray, low: float, high: float, count: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenvalues in (low, high], falling, and their unit vectors as columns.

    Subspace iteration with the quadrature filter and Rayleigh-Ritz until residuals reach rounding.
    If fewer Ritz values than the inertia count lie inside, the block and the nodes grow.
    """
    n = len(matrix)
    scale = max(norm_of(matrix), np.finfo(float).tiny)
    width, nodes = min(n, count + max(4, count // 2)), NODES
    for _ in range(4):
        block = np.random.default_rng(seed).normal(size=(n, width))
        best, before = None, np.inf
        for _ in range(30):
            basis, _ = np.linalg.qr(projected(matrix, low, high, block, nodes))
            values, turn = np.linalg.eigh(basis.T @ matrix @ basis)
            block = basis @ turn
            inside = np.flatnonzero((values > low) & (values <= high))[::-1]
            if len(inside) == count:
                pairs = values[inside], block[:, inside]
                residual = norm_of(matrix @ pairs[1] - pairs[1] * pairs[0])
                if residual < before / 2:
                    best, before = pairs, residual
                    if residual > 4 * np.finfo(float).eps * scale:
                        continue
                elif best is None:
                    best = pairs
                break
        if best is not None and before <= 1e-9 * scale:
            return best
        width, nodes = min(n, 2 * width), 2 * nodes
    raise RuntimeError(f"{count} eigenvalues between {low} and {high} were not all found")


def leading_eigenpairs(spark: SparkSession, matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` greatest eigenvalues, falling, and their vectors as columns; one task per interval.

    The matrix, whose width the caller bounds, goes to the tasks once. Eigenvalues that rounding
    cannot tell from zero are left out, so fewer pairs may come back.
    """
    n = len(matrix)
    trace = float(np.trace(matrix))
    if not n or not wanted or trace <= 0:
        return np.zeros(0), np.zeros((n, 0))
    parts = intervals(matrix, min(wanted, n))
    shared = spark.sparkContext.broadcast(matrix)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                values, vectors = eigenpairs_within(shared.value, row["low"], row["high"], row["count"])
                yield pa.record_batch(
                    [
                        pa.array([row["number"]] * len(values), pa.int32()),
                        pa.array(values, pa.float64()),
                        pa.array(list(vectors.T), pa.list_(pa.float64())),
                    ],
                    names=["number", "value", "vector"],
                )

    rows = [(i, float(a), float(b), c) for i, (a, b, c) in enumerate(parts) if c]
    jobs = spark.createDataFrame(rows, "number int, low double, high double, count int").repartition(len(rows), "number")
    found = jobs.mapInArrow(solve, PAIR_SCHEMA).collect()
    shared.unpersist()
    if len(found) != sum(r[3] for r in rows):
        raise RuntimeError("eigenpairs are missing")
    # One last Rayleigh-Ritz step over all intervals makes their vectors orthogonal to rounding.
    basis, _ = np.linalg.qr(np.array([r["vector"] for r in found]).T)
    values, turn = np.linalg.eigh(basis.T @ matrix @ basis)
    order = np.argsort(-values, kind="stable")[:wanted]
    order = order[values[order] > 1e-12 * trace]
    return values[order], (basis @ turn)[:, order]
