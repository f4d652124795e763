"""Iterative fits side by side: each asks for sums over all rows at a point and gets them in a shared job."""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CHUNK = 1 << 15  # numbers that travel together in a sum
PART_SCHEMA = "m int, part int, numbers binary"

Run = Generator[object, object, np.ndarray]  # yields points, is sent what the rows say, returns its result


def chunked(rows: Sequence[np.ndarray]) -> pa.RecordBatch:
    """One row per array and chunk of its numbers."""
    m, part, blobs = [], [], []
    for i, row in enumerate(rows):
        for at in range(0, len(row), CHUNK):
            m.append(i)
            part.append(at // CHUNK)
            blobs.append(np.ascontiguousarray(row[at : at + CHUNK], dtype=np.float64).tobytes())
    return pa.record_batch([pa.array(m, pa.int32()), pa.array(part, pa.int32()), pa.array(blobs, pa.binary())], names=["m", "part", "numbers"])


def joined(parts: DataFrame, count: int) -> list[np.ndarray]:
    """The arrays of ``chunked`` rows; they are small and come to the driver."""
    rows = sorted(parts.collect(), key=lambda r: (r["m"], r["part"]))
    return [np.concatenate([np.frombuffer(r["numbers"]) for r in rows if r["m"] == i]) for i in range(count)]


def added(parts: DataFrame, count: int) -> list[np.ndarray]:
    """Sums of partial arrays: their chunks are dealt over tasks and added as they come."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for m, part, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                own = np.frombuffer(blob)
                sums[m, part] = sums[m, part] + own if (m, part) in sums else own.copy()
        keys = sorted(sums)
        yield pa.record_batch(
            [
                pa.array([k[0] for k in keys], pa.int32()),
                pa.array([k[1] for k in keys], pa.int32()),
                pa.array([sums[k].tobytes() for k in keys], pa.binary()),
            ],
            names=["m", "part", "numbers"],
        )

    return joined(parts.repartition("m", "part").mapInArrow(add, PART_SCHEMA), count)


def advanced(runs: Sequence[Run], answer: Callable[[list[int], list], list]) -> list[np.ndarray]:
    """Results of all runs; in every round ``answer`` serves the points of those not done."""
    points = {i: next(run) for i, run in enumerate(runs)}
    done: dict[int, np.ndarray] = {}
    while points:
        open_ = sorted(points)
        for i, state in zip(open_, answer(open_, [points[i] for i in open_]), strict=True):
            try:
                points[i] = runs[i].send(state)
            except StopIteration as end:
                done[i] = end.value
                del points[i]
    return [done[i] for i in range(len(runs))]


def settled(
    data: DataFrame,
    parts: int,
    runs: Callable[[], Sequence[Run]],
    sums: Callable[[Iterable[pa.RecordBatch], list[int], list], Sequence[np.ndarray]],
    read: Callable[[Sequence[np.ndarray], list[int], list], list],
) -> list[np.ndarray]:
    """The results of all runs over ``data`` in ``parts`` partitions of bounded size.

    ``sums`` adds up arrays over some rows for the open runs at their points, ``read`` turns whole sums
    into what the runs are sent. A round is one job. Rows that fill one partition only are read once,
    by one task that goes through all rounds; the steps are the same.
    """
    if parts > 1:

        def answer(open_: list[int], points: list) -> list:
            def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                yield chunked(sums(batches, open_, points))

            return read(added(data.mapInArrow(partial, PART_SCHEMA), len(open_)), open_, points)

        return advanced(runs(), answer)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)  # one partition's share at most
        yield chunked(advanced(runs(), lambda open_, points: read(sums(held, open_, points), open_, points)))

    return joined(data.mapInArrow(solve, PART_SCHEMA), len(runs()))
