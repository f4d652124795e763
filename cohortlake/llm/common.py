"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlake.session import shared_folder

Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# The white space of every contract of this package: space, and tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def whole_text(text: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def lean(run: Task) -> Task:
    """``run``, giving freed memory back to the system at the end of every task.

    Python workers outlive their tasks, and what their allocators keep counts against the executor.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
        if trim is not None:
            trim(0)

    return task


def string_place(rows: DataFrame, text: str) -> int | None:
    """Where ``text`` stands in ``rows``, or null if it is not a string column of that very name."""
    return rows.columns.index(text) if text in rows.columns and rows.schema[text].dataType == T.StringType() else None


def lower_ascii(value: Column) -> Column:
    """Lower-case A-Z only. ``lower`` does just that for pure ASCII, at a fraction of the cost."""
    return F.when(F.octet_length(value) == F.char_length(value), F.lower(value)).otherwise(
        F.translate(value, UPPER, UPPER.lower())
    )


def remainder(ident: str, modulus: int) -> Column:
    """crc32 of the identifier as text, modulo ``modulus``; null identifiers give null."""
    return F.crc32(F.col(ident).cast("string").cast("binary")) % F.lit(modulus)


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends, executors may be lost."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def chosen_rows(labels: DataFrame, label: str, per_class: int, ident: str = "doc_id") -> DataFrame:
    """About ``per_class`` identifiers of each class, or all if there are fewer: (doc_id, label, weight).

    A row is chosen if its hash falls below the share that the class may have, so no class is ranked
    in one task; the number differs from ``per_class`` by a few times its square root. ``weight`` is
    the number of labelled rows that each chosen row stands for. Rows with a null identifier or
    label are left out; an identifier with several labels takes the greatest.
    """
    one = (
        labels.select(F.col(ident).cast("long").alias("doc_id"), F.col(label).alias("label"))
        .filter("doc_id is not null and label is not null")
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    sizes = one.groupBy("label").agg(F.greatest(F.lit(1.0), F.count(F.lit(1)) / F.lit(per_class)).alias("weight"))
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 11).cast("double") / float(1 << 53)
    return one.join(sizes, "label").filter(place * F.col("weight") < 1).select("doc_id", "label", "weight")


def texts_of(docs: DataFrame, chosen: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """(doc_id, text, label, weight) of the chosen rows.

    The chosen identifiers number ``per_class`` times the classes at most, which bounds the
    broadcast; so no text is shuffled. Of rows with the same identifier the least text counts.
    """
    body = docs.select(F.col(ident).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    found = body.join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"), F.first("weight").alias("weight"))


def learned_labels(labels: DataFrame, modulus: int, held_out: int, ident: str = "doc_id") -> DataFrame:
    """The rows to learn from: crc32 of the identifier modulo ``modulus`` is not ``held_out``."""
    return labels.filter(remainder(ident, modulus) != held_out)


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weighted logistic regression by damped Newton steps; the last coefficient is the intercept.

    One class, or no rows, gives the smoothed log odds as intercept and zero slopes.
    """
    x = np.hstack([x, np.ones((len(x), 1))])
    beta = np.zeros(x.shape[1])
    positive, total = float((weight * y).sum()), float(weight.sum())
    beta[-1] = np.log((positive + 0.5) / (total - positive + 0.5))
    if not 0 < positive < total:
        return beta
    weight = weight / weight.mean()
    penalty = ridge * len(x) * np.r_[np.ones(x.shape[1] - 1), 0.0]

    def loss(b):
        z = x @ b
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + (penalty * b * b).sum() / 2)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -50, 50)))
        slope = x.T @ (weight * (p - y)) + penalty * beta
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
        step, scale = np.linalg.solve(curve, slope), 1.0
        while scale > 1e-6 and loss(beta - scale * step) > loss(beta):
            scale /= 2
        beta = beta - scale * step
        if np.abs(scale * step).max() < 1e-8:
            break
    return beta


def logistic(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ beta[:-1] + beta[-1], -50, 50)))


SCORED_SCHEMA = "doc_id long, score double"


def scored(docs: DataFrame, score, text: str = "text", ident: str = "doc_id", rows: int = 500) -> DataFrame:
    """(doc_id, score) of every row; ``score`` makes a function from a list of texts to numbers.

    It is called once per task, and its function on ``rows`` whole texts at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = score()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                values = pa.array(of(part.column(1).to_pylist()), pa.float64())
                yield pa.record_batch([part.column(0), values], names=["doc_id", "score"])

    body = docs.select(F.col(ident).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    return body.mapInArrow(lean(run), SCORED_SCHEMA)


def decided(scores: DataFrame, modulus: int, held_out: int, bound: float) -> DataFrame:
    """Add held_out and predicted to (doc_id, score); a null identifier is not held out."""
    return scores.select(
        "doc_id",
        F.coalesce(remainder("doc_id", modulus) == held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= bound).cast("int").alias("predicted"),
    )
