"""Toxicity by a weighted lexicon, found with one Aho-Corasick pass over folded text.

Folding undoes look-alike letters and digits that stand for letters. Lexicon entries are whole words
and word beginnings with the log odds of toxic documents as weight; exception phrases cancel the
entries inside them. The weight found is normalised by the length of the text and calibrated.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.llm.common import (
    chosen_rows,
    decided,
    fit_logistic,
    learned_labels,
    logistic,
    scored,
    table,
    texts_of,
)

# Look-alikes of Latin letters in Cyrillic and Greek, and signs used for letters.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t",
    "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g", "ո": "n", "ѵ": "v", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t",
    "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o",
    "0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "|": "l", "€": "e",
}
SHORTEST, LONGEST = 4, 8  # letters of a word beginning
ALL_DIGITS = re.compile(r"(?<!\w)[\d.,:/%$€@|-]+(?!\w)")


class Folds(dict):
    """Character table for ``str.translate``: a letter's base form, or a space."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        base = LOOKALIKES.get(char)
        if base is None:
            plain = [c for c in unicodedata.normalize("NFKD", char).lower() if not unicodedata.combining(c)]
            base = "".join(LOOKALIKES.get(c, c) if c.isalnum() else " " for c in plain)
            if not plain and unicodedata.combining(char) or unicodedata.category(char) == "Cf":
                base = ""
        # i and l look alike in many faces and share the digit 1: they fold together.
        self[code] = base.replace("l", "i")
        return self[code]


def fold(text: str, folds: Folds) -> str:
    """Folded words with one blank around each; figures that stand alone are not letters."""
    return f" {' '.join(ALL_DIGITS.sub(' ', text.lower()).translate(folds).split())} "


def entries_of(folded: str) -> set[str]:
    """The lexicon entries a text could support: " word " and " beginning"."""
    words = set(folded.split())
    found = {f" {w} " for w in words if len(w) > 2}
    for w in words:
        found.update(" " + w[:k] for k in range(SHORTEST, min(LONGEST, len(w)) + 1))
    return found


def automaton(weights: dict[str, float], exceptions: set[str]):
    """Aho-Corasick automaton with (length, weight) of each entry; exceptions weigh nothing."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    for entry, weight in weights.items():
        machine.add_word(entry, (len(entry), weight))
    for phrase in exceptions:
        machine.add_word(phrase, (len(phrase), None))
    if weights or exceptions:
        machine.make_automaton()
    return machine


def hits(folded: str, machine) -> list[tuple[int, float]]:
    """(start, weight) of each word with an entry, its heaviest one, outside exception phrases."""
    best: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    if len(machine):
        for end, (length, weight) in machine.iter(folded):
            start = end - length + 1
            if weight is None:
                spared.append((start, end))
            elif weight > best.get(start, 0.0):
                best[start] = weight
    found = sorted(best.items())
    if not spared:
        return found
    # One sweep over both in order: the furthest end of the phrases begun so far decides.
    out, at, reach = [], 0, -1
    spared.sort()
    for start, weight in found:
        while at < len(spared) and spared[at][0] <= start:
            reach = max(reach, spared[at][1])
            at += 1
        if start >= reach:
            out.append((start, weight))
    return out


def features(folded: str, machine) -> tuple[float, float]:
    """The weight found and the weight per length, both on a logarithmic scale."""
    total = sum(w for _, w in hits(folded, machine))
    words = folded.count(" ") - 1
    return float(np.log1p(total)), float(np.log1p(100 * total / (max(0, words) + 50)))


@dataclass(frozen=True)
class ToxicityModel:
    weights: dict[str, float]
    exceptions: frozenset[str]
    beta: tuple[float, ...]

    def scorer(self) -> Callable[[], Callable[[list[str]], np.ndarray]]:
        def start():
            machine, folds = automaton(self.weights, self.exceptions), Folds()

            def of(texts: list[str]) -> np.ndarray:
                rows = [features(fold(t or "", folds), machine) for t in texts]
                return logistic(np.array(rows).reshape(-1, 2), np.array(self.beta))

            return of

        return start


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    per_class: int = 10_000,
    entries: int = 4000,
    least_odds: float = 4.5,
    least_share: float = 0.02,
    phrases: int = 2000,
    most_support: int = 50,
) -> ToxicityModel:
    """Learn from at most ``per_class`` labelled rows of each class (label 1 is toxic).

    Entries are supported by ``least_share`` of the toxic rows, at least 3 and no more than ``most_support``
    needed, and have log odds of ``least_odds``, or of three quarters of what an entry of all toxic and
    no clean row would have, if that is less; the ``entries`` strongest stay. Exception phrases are pairs of neighbouring
    words around an entry that clean rows hold at least 3 times and more often, per row, than toxic
    ones. Counting runs as partial counts per task; only the chosen entries reach the driver. Null
    labels and identifiers are left out. Without toxic or clean rows the lexicon is empty.
    """
    found = texts_of(docs, chosen_rows(labels, label, per_class)).withColumn("bad", F.col("label") == 1).persist()
    sizes = {r.bad: r["count"] for r in found.groupBy("bad").count().collect()}
    n_bad, n_fine = sizes.get(True, 0), sizes.get(False, 0)

    def counted(find: Callable[[], Callable[[str], set[str]]]) -> DataFrame:
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of, bad, fine = find(), Counter(), Counter()

            def flush() -> pa.RecordBatch:
                keys = list(bad.keys() | fine.keys())
                columns = [keys, [bad[k] for k in keys], [fine[k] for k in keys]]
                types = (pa.string(), pa.int64(), pa.int64())
                arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
                bad.clear(), fine.clear()
                return pa.record_batch(arrays, names=["entry", "bad", "fine"])

            for batch in batches:
                for text, is_bad in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    (bad if is_bad else fine).update(of(text))
                    if len(bad) + len(fine) > 500_000:
                        yield flush()
            yield flush()

        rows = found.select("text", "bad").mapInArrow(count, "entry string, bad long, fine long")
        return rows.groupBy("entry").agg(F.sum("bad").alias("bad"), F.sum("fine").alias("fine"))

    def all_entries():
        folds = Folds()
        return lambda text: entries_of(fold(text, folds))

    odds = F.log((F.col("bad") + 0.5) / F.lit(n_bad + 1.0)) - F.log((F.col("fine") + 0.5) / F.lit(n_fine + 1.0))
    support = max(3.0, min(least_share * n_bad, most_support))
    attainable = float(np.log((n_bad + 0.5) / (n_bad + 1.0)) - np.log(0.5 / (n_fine + 1.0)))
    least_odds = min(least_odds, 0.75 * attainable)
    strong = counted(all_entries).withColumn("odds", odds).filter((F.col("bad") >= support) & (F.col("odds") >= least_odds))
    weights = {}
    if n_bad and n_fine:
        weights = {r.entry: r.odds for r in strong.orderBy(F.col("odds").desc(), "entry").limit(entries).collect()}

    def all_phrases():
        folds, machine = Folds(), automaton(weights, set())

        def of(text: str) -> set[str]:
            folded, pairs = fold(text, folds), set()
            for start, _ in hits(folded, machine):
                end = folded.index(" ", start + 1)
                before = folded.rfind(" ", 0, start)
                if before >= 0:
                    pairs.add(folded[before : end + 1])
                after = folded.find(" ", end + 1)
                if after >= 0:
                    pairs.add(folded[start : after + 1])
            return pairs

        return of

    exceptions: set[str] = set()
    if weights:
        spared = counted(all_phrases).filter((F.col("fine") >= 3) & (F.col("fine") * n_bad > F.col("bad") * n_fine))
        exceptions = {r.entry for r in spared.orderBy(F.col("fine").desc(), "entry").limit(phrases).collect()}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, folds = automaton(weights, exceptions), Folds()
        for batch in batches:
            rows = np.array([features(fold(t, folds), machine) for t in batch.column(0).to_pylist()]).reshape(-1, 2)
            columns = [pa.array(rows[:, 0]), pa.array(rows[:, 1]), batch.column(1), batch.column(2)]
            yield pa.record_batch(columns, names=["total", "dense", "bad", "weight"])

    schema = "total double, dense double, bad boolean, weight double"
    rows = found.select("text", "bad", "weight").mapInArrow(measure, schema).collect()
    found.unpersist()
    x = np.array([[r.total, r.dense] for r in rows]).reshape(-1, 2)
    beta = fit_logistic(x, np.array([float(r.bad) for r in rows]), np.array([r.weight for r in rows]), ridge=1e-4)
    return ToxicityModel(weights, frozenset(exceptions), tuple(float(b) for b in beta))


def toxicity_scores(docs: DataFrame, model: ToxicityModel, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """(doc_id, score) for every row of ``docs``, in one pass without a shuffle.

    Null and empty texts hold no entry and get the score of that. Repeated rows are scored alike.
    """
    return scored(docs, model.scorer(), text, ident)


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """The toxicity score of every document, learned where crc32(doc_id) mod 4 is not 2."""
    docs = table(spark, folder, "documents")
    model = fit_toxicity(docs, learned_labels(table(spark, folder, "labels"), 4, 2))
    return decided(toxicity_scores(docs, model), 4, 2, 0.3)
