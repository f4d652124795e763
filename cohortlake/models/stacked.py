"""Several logistic models fitted side by side: every step is one job that serves all of them.

A model says which rows it may not see, how it weighs classes and how it scales features. The
parameters of all models form one stacked matrix; a task multiplies its rows with it once and returns
one partial sum of loss and gradient per model. Limited-memory BFGS runs on the small parameters.
"""

from __future__ import annotations

from collections.abc import Generator, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlake.functions.vector import as_double, matrix_of
from cohortlake.models.output import LinearModel, training_rows
from cohortlake.models.rounds import Run, settled


@dataclass(frozen=True)
class Design:
    """One model to fit. Rows of group ``excluded`` are unseen; a zero in ``inverse`` leaves a feature out."""

    excluded: int | None
    class_weights: np.ndarray
    means: np.ndarray
    inverse: np.ndarray
    total: float  # weight of all rows it sees
    C: float = 1.0


@dataclass
class GroupMoments:
    """Rows per group and class, and the mean and population variance of each feature per group."""

    counts: np.ndarray  # groups x classes
    means: np.ndarray  # groups x features
    variances: np.ndarray

    def design(self, excluded: int | None, balanced: bool, C: float, keep: Sequence[int] | None = None) -> Design:
        """The design that sees all groups but one, scaled and weighed by what it sees.

        A class without a row gets no weight, a constant feature the factor 1, as it is 0 once centred.
        """
        seen = np.array([g != excluded for g in range(len(self.counts))])
        rows = self.counts[seen].sum(axis=1)
        n = rows.sum()
        if not n:
            raise ValueError("no rows to train on")
        means = (self.means[seen] * rows[:, None]).sum(axis=0) / n
        spread = ((self.variances[seen] + (self.means[seen] - means) ** 2) * rows[:, None]).sum(axis=0) / n
        std = np.sqrt(spread)
        inverse = 1.0 / np.where(std == 0, 1.0, std)
        if keep is not None:
            chosen = np.zeros(len(means), dtype=bool)
            chosen[list(keep)] = True
            inverse = np.where(chosen, inverse, 0.0)
        per_class = self.counts[seen].sum(axis=0).astype(float)
        present = per_class > 0
        weights = np.where(present, 1.0, 0.0)
        if balanced:
            weights = np.where(present, n / (present.sum() * np.maximum(per_class, 1.0)), 0.0)
        return Design(excluded, weights, means, inverse, float((weights * per_class).sum()), C)


def group_moments(rows: DataFrame, groups: int, classes: int) -> GroupMoments:
    """Moments of ``(g, y, x)`` rows in one pass: shifted sums per task, merged by group."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[int, list] = {}
        for batch in batches:
            g, y, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix_of(batch.column(2))
            for one in np.unique(g):
                own, mine = x[g == one], np.bincount(y[g == one], minlength=classes)
                mean = own.mean(axis=0)
                squares = ((own - mean) ** 2).sum(axis=0)
                if one in state:
                    n, counts, old, old_squares = state[one]
                    apart, total = mean - old, n + len(own)
                    squares += old_squares + apart**2 * n * len(own) / total
                    mean, mine = old + apart * len(own) / total, mine + counts
                    state[one] = [total, mine, mean, squares]
                else:
                    state[one] = [len(own), mine, mean, squares]
        for one, (n, counts, mean, squares) in state.items():
            yield pa.record_batch(
                [pa.array([one], pa.int32()), pa.array([n], pa.int64()), pa.array([counts.tolist()], pa.list_(pa.int64())),
                 pa.array([mean.tolist()]), pa.array([squares.tolist()])],
                names=["g", "n", "counts", "mean", "squares"],
            )

    parts = rows.select("g", "y", "x").mapInArrow(add, "g int, n long, counts array<long>, mean array<double>, squares array<double>")
    cells = parts.select("g", "n", F.posexplode(F.arrays_zip("mean", "squares")).alias("j", "s"))
    whole = cells.groupBy("g", "j").agg(F.sum("n").alias("n"), (F.sum(F.col("s.mean") * F.col("n")) / F.sum("n")).alias("mean"))
    spread = cells.join(whole.select("g", "j", F.col("mean").alias("m")), ["g", "j"]).groupBy("g", "j").agg(
        F.first("m").alias("mean"),
        (F.sum(F.col("s.squares") + (F.col("s.mean") - F.col("m")) ** 2 * F.col("n")) / F.sum("n")).alias("var"),
    )
    found = spread.toArrow()
    per_class = parts.select("g", F.posexplode("counts").alias("c", "n")).groupBy("g", "c").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros((groups, classes), dtype=np.int64)
    for r in per_class:
        counts[r["g"], r["c"]] = r["n"]
    g, j, mean, var = (found.column(c).to_numpy() for c in ("g", "j", "mean", "var"))
    width = int(j.max()) + 1 if len(j) else 0
    means, variances = np.zeros((groups, width)), np.zeros((groups, width))
    means[g, j], variances[g, j] = mean, var
    return GroupMoments(counts, means, variances)


def summed(batches: Iterable[pa.RecordBatch], designs: Sequence[Design], points: Sequence[np.ndarray]) -> np.ndarray:
    """Per design over some ``(g, y, x)`` rows: weighted loss, and its slope by output and by raw feature."""
    outputs, width = points[0].shape[0], points[0].shape[1] - 1
    count = len(designs)
    slopes = np.concatenate([(p[:, :-1] * d.inverse).T for p, d in zip(points, designs, strict=True)], axis=1)
    shifts = np.concatenate([p[:, -1] - p[:, :-1] @ (d.means * d.inverse) for p, d in zip(points, designs, strict=True)])
    weigh = np.array([d.class_weights for d in designs])
    unseen = np.array([-1 if d.excluded is None else d.excluded for d in designs])
    total = np.zeros((count, 1 + outputs * (width + 1)))
    for batch in batches:
        g, y, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix_of(batch.column(2))
        if not len(x):
            continue
        z = (x @ slopes + shifts).reshape(len(x), count, outputs)
        w = weigh[:, y].T * (g[:, None] != unseen[None, :])
        if outputs == 1:
            sign = (2.0 * y - 1.0)[:, None]
            loss = np.logaddexp(0.0, -sign * z[:, :, 0])
            r = (-sign * np.exp(-np.logaddexp(0.0, sign * z[:, :, 0])))[:, :, None]
        else:
            top = z.max(axis=2, keepdims=True)
            e = np.exp(z - top)
            norm = e.sum(axis=2, keepdims=True)
            loss = (np.log(norm) + top)[:, :, 0] - z[np.arange(len(y)), :, y]
            r = e / norm
            r[np.arange(len(y)), :, y] -= 1.0
        r *= w[:, :, None]
        total[:, 0] += (w * loss).sum(axis=0)
        total[:, 1 : 1 + outputs] += r.sum(axis=0)
        total[:, 1 + outputs :] += (x.T @ r.reshape(len(x), -1)).T.reshape(count, outputs * width)
    return total


def losses(sums: Sequence[np.ndarray], designs: Sequence[Design], points: Sequence[np.ndarray]) -> list[tuple[float, np.ndarray]]:
    """Penalised mean loss and its gradient of each design at its (outputs, features + 1) point.

    One output is the binary model of class 1; several are a softmax over the classes.
    """
    outputs, width = points[0].shape[0], points[0].shape[1] - 1
    out = []
    for point, design, row in zip(points, designs, sums, strict=True):
        free, raw = row[1 : 1 + outputs], row[1 + outputs :].reshape(outputs, width)
        slope = (raw - free[:, None] * design.means) * design.inverse / design.total
        ridge = 1.0 / (design.C * design.total)
        value = row[0] / design.total + ridge * float((point[:, :-1] ** 2).sum()) / 2
        out.append((value, np.hstack([slope + ridge * point[:, :-1], free[:, None] / design.total])))
    return out


def descent(start: np.ndarray, max_iter: int, tolerance: float, memory: int = 10) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """L-BFGS as a coroutine: yields points, is sent (value, gradient), returns the last accepted point."""
    x = start
    value, gradient = yield x
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(max_iter):
        if np.abs(gradient).max() <= tolerance:
            break
        direction, factors = -gradient, []
        for s, y in reversed(steps):
            a = float((s * direction).sum() / (s * y).sum())
            factors.append(a)
            direction = direction - a * y
        if steps:
            s, y = steps[-1]
            direction = direction * float((s * y).sum() / (y * y).sum())
        for (s, y), a in zip(steps, reversed(factors), strict=True):
            direction = direction + s * (a - float((y * direction).sum() / (s * y).sum()))
        slope = float((gradient * direction).sum())
        if slope >= 0:  # curvature lost to rounding
            steps, direction, slope = [], -gradient, -float((gradient**2).sum())
        length = 1.0 if steps else min(1.0, 1.0 / float(np.sqrt((gradient**2).sum())))
        while True:
            trial = x + length * direction
            new_value, new_gradient = yield trial
            if new_value <= value + 1e-4 * length * slope:
                break
            length /= 2
            if length < 1e-12:
                return x.ravel()
        change = trial - x, new_gradient - gradient
        if float((change[0] * change[1]).sum()) > 1e-14 * float((change[1] ** 2).sum()):
            steps = [*steps[1 - memory :], change]
        x, value, gradient = trial, new_value, new_gradient
    return x.ravel()


def fit_stacked(rows: DataFrame, designs: Sequence[Design], classes: int, max_iter: int = 1000, tolerance: float = 1e-6) -> list[LinearModel]:
    """The logistic model of every design on ``(g, y, x)`` rows; weights are those of scaled features.

    A step is one job for all models, whatever their number; see ``settled``.
    """
    outputs, width = (1 if classes == 2 else classes), len(designs[0].means)

    def start() -> list[Run]:
        return [descent(np.zeros((outputs, width + 1)), max_iter, tolerance) for _ in designs]

    with training_rows(rows.withColumn("__w", F.lit(1.0)), width) as (data, _, parts):
        ends = settled(
            data.select("g", "y", "x"),
            parts,
            start,
            lambda batches, open_, points: summed(batches, [designs[i] for i in open_], points),
            lambda sums, open_, points: losses(sums, [designs[i] for i in open_], points),
        )
    fitted = [e.reshape(outputs, width + 1) for e in ends]
    return [LinearModel(f[:, :-1].tolist(), f[:, -1].tolist(), "softmax" if outputs > 1 else "logistic") for f in fitted]


def stacked_rows(group: Column, index: Column, vector: Column) -> list[Column]:
    """The columns that ``fit_stacked`` reads."""
    return [group.cast("int").alias("g"), index.cast("int").alias("y"), as_double(vector).alias("x")]
