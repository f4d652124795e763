"""Language by nearest centroid: TF-IDF vectors of character n-grams against clustered centroids."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.llm.common import chosen_rows, learned_labels, remainder, table, texts_of, whole_text

WIDTH = 1 << 12  # hashed n-grams
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
SCORED_SCHEMA = "doc_id long, lang_pred string, score double, rejected boolean"


def ngram_counts(text: str) -> np.ndarray:
    """Hashed counts of the two- and three-byte grams of the lower-cased text, blanks around it."""
    codes = np.frombuffer(b" " + " ".join(text.lower().split()).encode("utf-8", "surrogatepass") + b" ", dtype=np.uint8)
    codes = codes.astype(np.uint32)
    pairs = codes[:-1] * np.uint32(0x9E3779B1) + codes[1:] * np.uint32(0x85EBCA77)
    triples = pairs[:-1] * np.uint32(0xC2B2AE3D) + codes[2:] * np.uint32(0x27D4EB2F)
    shift = np.uint32(32 - WIDTH.bit_length() + 1)
    return np.bincount(pairs >> shift, minlength=WIDTH) + np.bincount(triples >> shift, minlength=WIDTH)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of (1 + ln count) * idf with unit length."""
    tf = np.log(counts, out=np.full(counts.shape, -1.0), where=counts > 0) + 1
    weighted = tf * idf
    return weighted / np.maximum(np.linalg.norm(weighted, axis=1, keepdims=True), 1e-12)


def clusters(rows: np.ndarray, k: int, seed: int, steps: int = 25) -> np.ndarray:
    """Unit centroids of spherical k-means; at most as many as there are rows."""
    rng = np.random.default_rng(seed)
    centres = rows[rng.choice(len(rows), min(k, len(rows)), replace=False)]
    for _ in range(steps):
        nearest = np.argmax(rows @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, rows)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        moved = np.where(norms > 0, sums / np.maximum(norms, 1e-12), centres)
        if np.allclose(moved, centres):
            break
        centres = moved
    return centres


@dataclass(frozen=True)
class LanguageModel:
    """Centroids with their languages, the idf weights, and the least usual cosine of each language."""

    languages: tuple[str, ...]
    centroids: np.ndarray
    owner: np.ndarray
    idf: np.ndarray
    least: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """Language, cosine to its nearest centroid (0 to 1) and rejection of each text."""
        names, scores, rejected = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
        rows = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
        if rows and self.languages:
            cosine = vectors(np.array([ngram_counts(texts[i]) for i in rows]), self.idf) @ self.centroids.T
            best = np.argmax(cosine, axis=1)
            for i, b, c in zip(rows, best, cosine[np.arange(len(rows)), best], strict=True):
                own = self.owner[b]
                names[i], scores[i] = self.languages[own], float(min(1.0, max(0.0, c)))
                rejected[i] = bool(c < self.least[own])
        return names, scores, rejected


def fit_language(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "lang",
    per_class: int = 400,
    centroids: int = 6,
    tail: float = 0.005,
    seed: int = 5,
) -> LanguageModel:
    """Learn from at most ``per_class`` rows of each language, drawn by hash, on their whole texts.

    Each language gets up to ``centroids`` clustered centroids. A text is rejected if its cosine to
    the nearest one is below that of all but a ``tail`` of the learned rows of the language. Rows
    with a null language or identifier, or without a letter, are left out; without any row the
    model knows no language.
    """
    found = texts_of(docs, chosen_rows(labels, label, per_class))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, names = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            pairs = [(n, ngram_counts(t).astype("<u4").tobytes()) for t, n in zip(texts, names, strict=True) if LETTER.search(t)]
            columns = [pa.array([n for n, _ in pairs], pa.string()), pa.array([c for _, c in pairs], pa.binary())]
            yield pa.record_batch(columns, names=["label", "counts"])

    counted = found.select("text", F.col("label").cast("string").alias("label"))
    rows = sorted((r.label, bytes(r.counts)) for r in counted.mapInArrow(count, "label string, counts binary").collect())
    languages = sorted({name for name, _ in rows})
    counts = np.array([np.frombuffer(c, "<u4") for _, c in rows]).reshape(-1, WIDTH)
    idf = np.log((1 + len(rows)) / (1 + (counts > 0).sum(axis=0))) + 1
    units = vectors(counts.astype(float), idf)
    labels_of = np.array([languages.index(name) for name, _ in rows], dtype=int)
    found_centres, owner, least = [], [], []
    for k in range(len(languages)):
        own = units[labels_of == k]
        centres = clusters(own, centroids, seed + k)
        found_centres.append(centres)
        owner.extend([k] * len(centres))
        least.append(np.quantile((own @ centres.T).max(axis=1), tail))
    stacked = np.vstack(found_centres) if found_centres else np.zeros((0, WIDTH))
    return LanguageModel(tuple(languages), stacked, np.array(owner, dtype=int), idf, np.array(least))


def languages_of(docs: DataFrame, model: LanguageModel, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for every row of ``docs``, in one pass without a shuffle.

    Null texts and texts without a letter are ``und`` with score 0 and rejected. A rejected text
    keeps its nearest language in ``lang_pred``, so the caller decides what rejection means.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                names, scores, rejected = model.predict(part.column(1).to_pylist())
                columns = [part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected)]
                yield pa.record_batch(columns, names=["doc_id", "lang_pred", "score", "rejected"])

    body = docs.select(F.col(ident).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    return body.mapInArrow(run, SCORED_SCHEMA)


def op10_language(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document, learned where crc32(doc_id) mod 4 is not 2."""
    docs = table(spark, folder, "documents")
    known = docs.filter("text is not null").select("doc_id", "lang")
    model = fit_language(docs, learned_labels(known, 4, 2))
    found = languages_of(docs, model)
    held = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return found.select("doc_id", held, "lang_pred", "score", "rejected")
