"""Registry of sequence embedders: name -> vectors of a sequence column.

An embedder is either a column builder, or a batched model: a function that opens the model, once per
task, and returns what turns a list of texts into a matrix. Each has its width and the backend name
stored with the vectors. The number of texts a model sees at a time belongs to the job that runs it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlake.functions.sequence import COMPOSITION_DIM, composition
from cohortlake.functions.vector import list_array

BATCH = 64
# A task sorts this many batches, or this many letters, by length at a time.
POOL_BATCHES, POOL_LETTERS = 32, 1 << 24

Model = Callable[[list[str]], np.ndarray]


@dataclass(frozen=True)
class Embedder:
    backend: str
    dim: int
    vector: Callable[[Column], Column] | None = None
    open_model: Callable[[], Model] | None = None


_REGISTRY: dict[str, Embedder] = {"dummy": Embedder("dummy", COMPOSITION_DIM, composition)}


def register_embedder(name: str, dim: int, vector: Callable[[Column], Column]) -> None:
    """Make ``name`` (case-insensitive) available to ``embedder``."""
    _REGISTRY[name.lower()] = Embedder(name, dim, vector)


def register_batch_embedder(name: str, dim: int, open_model: Callable[[], Model]) -> None:
    """Make a batched model available: ``open_model()`` runs once per task and returns texts -> (n, dim)."""
    _REGISTRY[name.lower()] = Embedder(name, dim, open_model=open_model)


def embedder(name: str | None) -> Embedder:
    """Look up an embedder; an empty name means the composition embedder."""
    key = (name or "dummy").lower()
    if key not in _REGISTRY:
        raise ValueError(f"Unknown backend '{name}'. Registered: {sorted(_REGISTRY)}")
    return _REGISTRY[key]


def batches_by_length(lengths: np.ndarray, size: int) -> list[np.ndarray]:
    """Positions in batches of ``size``, texts of similar length together; only the last is smaller."""
    order = np.argsort(lengths, kind="stable")
    return [order[at : at + size] for at in range(0, len(order), size)]


def pooled(batches: Iterator[pa.RecordBatch], sequence: int, size: int) -> Iterator[pa.RecordBatch]:
    """The rows in pools of up to ``POOL_BATCHES`` batches and about ``POOL_LETTERS`` letters, in their order."""
    held: list[pa.RecordBatch] = []
    rows = letters = 0

    def pool() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        lengths = np.array([len(s or "") for s in batch.column(sequence).to_pylist()], dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            fits = int(np.searchsorted(np.cumsum(lengths[at:]), POOL_LETTERS - letters, side="right"))
            take = min(fits, size * POOL_BATCHES - rows, batch.num_rows - at)
            if take == 0 and rows:  # full: a text longer than a pool starts one
                yield pool()
                held, rows, letters = [], 0, 0
                continue
            take = max(1, take)
            held.append(batch.slice(at, take))
            rows += take
            letters += int(lengths[at : at + take].sum())
            at += take
    if rows:
        yield pool()


def with_vectors(df: DataFrame, sequence: str, chosen: Embedder, batch: int = BATCH, name: str = "embedding") -> DataFrame:
    """``df`` with the vector column ``name``, in the order of its rows.

    A batched model sees ``batch`` texts of similar length at a time; null texts go in as empty ones. It
    must return one finite-width row per text, else the job fails with the model's name.
    """
    if batch < 1:
        raise ValueError(f"a batch needs at least one text, not {batch}")
    if chosen.open_model is None:
        return df.withColumn(name, chosen.vector(F.col(sequence)))
    if name in df.columns:
        raise ValueError(f"the rows already have a column '{name}'")
    at, open_model, dim, backend = df.columns.index(sequence), chosen.open_model, chosen.dim, chosen.backend

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for pool in pooled(batches, at, batch):
            model = model or open_model()
            texts = [s or "" for s in pool.column(at).to_pylist()]
            vectors = np.zeros((len(texts), dim), dtype=np.float32)
            for rows in batches_by_length(np.array([len(t) for t in texts]), batch):
                found = np.asarray(model([texts[i] for i in rows]))
                if found.shape != (len(rows), dim):
                    raise ValueError(f"backend '{backend}' gave an array of {found.shape} for {len(rows)} texts of {dim} entries")
                vectors[rows] = found
            yield pa.RecordBatch.from_arrays([*pool.columns, list_array(vectors)], names=[*pool.schema.names, name])

    schema = T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.FloatType()))])
    return df.mapInArrow(run, schema)
