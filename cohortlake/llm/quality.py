"""Quality by compression: which of two dictionaries, from good and from bad text, codes a text shorter."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlake.llm.common import (
    chosen_rows,
    decided,
    fit_logistic,
    lean,
    learned_labels,
    logistic,
    scored,
    string_place,
    table,
    texts_of,
    whole_text,
)

PIECE = 2048  # bytes coded at a time, so that a long text is judged by the dictionaries throughout
DICTIONARY = 112 * 1024
LEVEL = 3


def pieces(text: bytes) -> list[bytes]:
    return [text[at : at + PIECE] for at in range(0, len(text), PIECE)]


def coder(dictionary: bytes) -> zstandard.ZstdCompressor:
    """A compressor whose output is the coded text and as little else as possible."""
    known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    if known is not None:
        known.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(
        level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False
    )


def size_difference(texts: list[str], good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> np.ndarray:
    """Bytes that the good dictionary saves against the bad one, per byte of text; 0 for empty texts."""
    out = np.zeros(len(texts))
    for i, text in enumerate(texts):
        coded = (text or "").encode("utf-8", "surrogatepass")
        saved = sum(len(bad.compress(p)) - len(good.compress(p)) for p in pieces(coded))
        out[i] = saved / max(1, len(coded))
    return out


@dataclass(frozen=True)
class QualityModel:
    """Two dictionaries and the calibration of the size difference."""

    good: bytes
    bad: bytes
    beta: tuple[float, ...]

    def scorer(self) -> Callable[[], Callable[[list[str]], np.ndarray]]:
        def start():
            good, bad = coder(self.good), coder(self.bad)
            return lambda texts: logistic(size_difference(texts, good, bad)[:, None], np.array(self.beta))

        return start


def dictionary_from(samples: list[bytes]) -> bytes:
    """A dictionary of the samples; too few samples serve as raw content themselves."""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-DICTIONARY:]


def fit_quality(
    docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 6000, dictionary_pieces: int = 3000
) -> QualityModel:
    """Learn from at most ``per_class`` labelled rows of each class (label 1 is good, others bad).

    Half of the chosen rows, by hash, fill the dictionaries: at most ``dictionary_pieces`` pieces of
    each class, drawn by hash from their whole texts. The other half, which the dictionaries have
    not seen, calibrates the difference on whole texts, weighted to the frequencies of all labelled
    rows. Null labels and identifiers are left out. Without labelled rows every score is a half.
    """
    found = texts_of(docs, chosen_rows(labels, label, per_class)).withColumn("good", F.col("label") == 1)
    found = found.withColumn("half", F.xxhash64("doc_id", F.lit("half")) % 2 == 0).persist()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                yield pa.record_batch([pa.array(pieces(text.encode()), pa.binary())], names=["piece"])

    dictionaries = []
    for good in (True, False):
        own = found.filter((F.col("good") == good) & F.col("half")).select("text").mapInArrow(lean(cut), "piece binary")
        drawn = own.orderBy(F.xxhash64("piece"), "piece").limit(dictionary_pieces)
        dictionaries.append(dictionary_from([bytes(r.piece) for r in drawn.collect()]))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, bad = coder(dictionaries[0]), coder(dictionaries[1])
        for batch in batches:
            saved = size_difference(batch.column(0).to_pylist(), good, bad)
            columns = [pa.array(saved, pa.float64()), batch.column(1), batch.column(2)]
            yield pa.record_batch(columns, names=["saved", "good", "weight"])

    rest = found.filter(~F.col("half")).select("text", "good", "weight")
    rows = rest.mapInArrow(lean(measure), "saved double, good boolean, weight double").collect()
    found.unpersist()
    x = np.array([[r.saved] for r in rows]).reshape(-1, 1)
    # A scale near one for the ridge penalty; it is folded back into the slope.
    scale = float(x.std()) or 1.0 if len(rows) else 1.0
    beta = fit_logistic(x / scale, np.array([float(r.good) for r in rows]), np.array([r.weight for r in rows]))
    return QualityModel(*dictionaries, (float(beta[0] / scale), float(beta[1])))


def quality_scores(docs: DataFrame, model: QualityModel, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """(doc_id, score) for every row of ``docs``, in one pass without a shuffle.

    Null and empty texts get the score of no difference. Repeated rows are scored alike.
    """
    return scored(docs, model.scorer(), text, ident)


def quality_filtered(docs: DataFrame, model: QualityModel, bound: float, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is at least ``bound``, in one pass without a shuffle."""
    schema = T.StructType([*docs.schema.fields, T.StructField("__score", T.DoubleType())])
    width, place = len(docs.columns), string_place(docs, text)
    # A text that is not a string yet travels beside the row as one; others travel once.
    rows = docs.select("*", whole_text(text).alias("__text")) if place is None else docs
    place = width if place is None else place

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                values = pa.array(of(part.column(place).to_pylist()), pa.float64())
                yield pa.record_batch([*part.columns[:width], values], names=[*part.schema.names[:width], "__score"])

    scores = rows.mapInArrow(lean(run), schema)
    return scores.filter(F.col("__score") >= bound).drop("__score")


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    """The quality score of every document, learned where crc32(doc_id) mod 3 is not 1."""
    docs = table(spark, folder, "documents")
    model = fit_quality(docs, learned_labels(table(spark, folder, "labels"), 3, 1))
    return decided(quality_scores(docs, model), 3, 1, 0.5)
