"""Benchmark decontamination: BM25 over the test items with block-max WAND, then overlap checks.

The index holds the test items, never the corpus. Every window of every document is a query. Scores
are BM25 weights of an item's words divided by the score of the item for itself, so one threshold
suits all items. Most windows are decided by block maxima alone, with array sums over a whole batch;
the blocks they leave open are searched by WAND.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlake.llm.common import lean, string_place, table, whole_text

WORD = re.compile(r"[^\W_]+")
SEGMENT = 64  # words of an indexed part of an item; windows have two, so one holds any part whole
BLOCKS = 256  # at most; larger indexes have larger blocks
SMALLEST_BLOCK = 4  # parts
K1, B = 1.2, 0.75
GRAM = 3
INDEX_BYTES = 32 << 20
BOUND_CELLS = 1 << 22  # block maxima gathered at a time


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def halves(text: str, least: int) -> tuple[list[str], list[str]]:
    """Question and answer of an item: the answer is its last line, else its last sentence.

    An item whose question or answer would have fewer than ``least`` words is cut after two thirds.
    """
    for cut in (r"\n+(?=[^\n]*\S[^\n]*\s*$)", r"(?<=[.?!:])\s+(?=[^.?!:]*[.?!]?\s*$)"):
        parts = re.split(cut, text.strip(), maxsplit=1)
        if len(parts) == 2:
            question, answer = map(words_of, parts)
            if len(question) >= least and len(answer) >= least:
                return question, answer
    words = words_of(text)
    cut = max(1, len(words) * 2 // 3)
    return words[:cut], words[cut:]


def grams(words: list[str]) -> set[tuple[str, ...]]:
    n = min(GRAM, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def share(part: set, whole: set) -> float:
    return len(part & whole) / len(part) if part else 1.0


@dataclass
class Index:
    """Inverted index of item parts in blocks, with the greatest weight of each word per block."""

    item_ids: list[int]
    parts: list[tuple[int, set, set]] = field(default_factory=list)  # item, question grams, answer grams
    terms: dict[str, int] = field(default_factory=dict)
    posting_parts: list[np.ndarray] = field(default_factory=list)
    posting_weights: list[np.ndarray] = field(default_factory=list)
    posting_blocks: list[dict[int, tuple[list[int], list[float]]]] = field(default_factory=list)
    block_max: np.ndarray | None = None
    block_size: int = 1
    reach: int = 0

    @classmethod
    def of(cls, items: list[tuple[int, str]], least_words: int) -> Index:
        index = cls([i for i, _ in items])
        bags: list[list[str]] = []
        for number, (_, text) in enumerate(items):
            words = words_of(text or "")
            if len(words) < least_words:
                continue
            question, answer = halves(text, 3)
            index.reach = max(index.reach, len(words))
            for at in range(0, max(1, len(words) - least_words + 1), SEGMENT):
                bags.append(words[at : at + SEGMENT])
                index.parts.append((number, grams(question), grams(answer)))
        count = len(bags)
        mean = sum(map(len, bags)) / max(1, count)
        holders: dict[str, list[tuple[int, int]]] = {}
        for part, bag in enumerate(bags):
            for word in set(bag):
                holders.setdefault(word, []).append((part, bag.count(word)))
        own = np.zeros(count)
        for number, (word, found) in enumerate(sorted(holders.items())):
            index.terms[word] = number
            idf = np.log(1 + (count - len(found) + 0.5) / (len(found) + 0.5))
            which = np.array([p for p, _ in found])
            tf = np.array([n for _, n in found], dtype=float)
            length = np.array([len(bags[p]) for p in which])
            weight = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))
            own[which] += weight
            index.posting_parts.append(which)
            index.posting_weights.append(weight)
        index.block_size = max(1, -(-count // BLOCKS), min(SMALLEST_BLOCK, count))
        blocks = -(-count // index.block_size) if count else 0
        index.block_max = np.zeros((len(index.terms) + 1, blocks), dtype=np.float32)  # the last row: no word
        for number, which in enumerate(index.posting_parts):
            index.posting_weights[number] = index.posting_weights[number] / own[which]
            np.maximum.at(index.block_max[number], which // index.block_size, index.posting_weights[number])
            blocks_of: dict[int, tuple[list[int], list[float]]] = {}
            for part, weight in zip(which.tolist(), index.posting_weights[number].tolist(), strict=True):
                own_parts, own_weights = blocks_of.setdefault(part // index.block_size, ([], []))
                own_parts.append(part)
                own_weights.append(weight)
            index.posting_blocks.append(blocks_of)
        return index

    def wand(self, terms: np.ndarray, block: int, threshold: float) -> list[int]:
        """The parts of a block whose score for the query terms reaches the threshold."""
        most = self.block_max[terms, block]
        lists = []
        for t, bound in zip(terms[most > 0].tolist(), most[most > 0].tolist(), strict=True):
            parts, weights = self.posting_blocks[t][block]
            lists.append([parts, weights, 0, bound])
        found = []
        while lists:
            lists.sort(key=lambda x: x[0][x[2]])
            bound, pivot = 0.0, -1
            for k, entry in enumerate(lists):
                bound += entry[3]
                if bound >= threshold - 1e-6:
                    pivot = k
                    break
            if pivot < 0:
                break
            part = lists[pivot][0][lists[pivot][2]]
            if lists[0][0][lists[0][2]] == part:
                score = 0.0
                for entry in lists:
                    if entry[0][entry[2]] == part:
                        score += entry[1][entry[2]]
                        entry[2] += 1
                if score >= threshold - 1e-9:
                    found.append(part)
            else:
                for entry in lists[:pivot]:
                    while entry[2] < len(entry[0]) and entry[0][entry[2]] < part:
                        entry[2] += 1
            lists = [entry for entry in lists if entry[2] < len(entry[0])]
        return found


def leaks_in(texts: list[str], index: Index, threshold: float, overlap: float) -> list[dict[int, float]]:
    """For each text the leaked items with their confirmed overlap."""
    none = len(index.terms)
    look = index.terms.get
    tokens = [words_of(t) for t in texts]
    out: list[dict[int, float]] = [{} for _ in texts]
    if not index.parts:
        return out
    # The known words of each window (two neighbouring segments), once each, and their block maxima.
    ids = [np.fromiter((look(w, none) for w in words), dtype=np.int64, count=len(words)) for words in tokens]
    windows = np.array([-(-len(t) // SEGMENT) for t in ids])
    begins = np.cumsum(windows) - windows
    keys = []
    for begin, terms in zip(begins, ids, strict=True):
        at = np.nonzero(terms != none)[0]
        segment, word = begin + at // SEGMENT, terms[at]
        keys.append(segment * (none + 1) + word)
        after = segment > begin  # a window also holds the segment behind its own
        keys.append((segment[after] - 1) * (none + 1) + word[after])
    keys = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    if not len(keys):
        return out
    window_of, words_in = np.divmod(keys, none + 1)
    first = np.concatenate([[0], np.nonzero(np.diff(window_of))[0] + 1])
    ends = np.append(first[1:], len(keys))
    step = max(1, BOUND_CELLS // index.block_max.shape[1])
    start = 0
    while start < len(first):
        # As many windows at a time as keep the gathered maxima within their bound.
        stop = max(start + 1, int(np.searchsorted(ends, first[start] + step, side="right")))
        base = first[start]
        bounds = np.add.reduceat(index.block_max[words_in[base : ends[stop - 1]]], first[start:stop] - base, axis=0)
        for row, block in zip(*np.nonzero(bounds >= threshold - 1e-4), strict=True):
            window = start + row
            query = words_in[first[window] : ends[window]]
            n = int(np.searchsorted(begins + windows, window_of[first[window]], side="right"))
            at = int(window_of[first[window]] - begins[n]) * SEGMENT
            for part in index.wand(query, int(block), threshold):
                item, question, answer = index.parts[part]
                if item in out[n]:
                    continue
                near = grams(tokens[n][max(0, at - index.reach) : at + 2 * SEGMENT + index.reach])
                found = min(share(question, near), share(answer, near))
                if found >= overlap:
                    out[n][item] = found
        start = stop
    return out


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    threshold: float = 0.5,
    overlap: float = 0.5,
    least_words: int = 5,
    text: str = "text",
    ident: str = "doc_id",
    item: str = "item_id",
    item_text: str = "text",
    keep: list[str] | None = None,
    index_bytes: int = INDEX_BYTES,
) -> DataFrame:
    """Each row of ``docs`` with items (leaked item ids, sorted) and overlap (the greatest, or null).

    The result has the identifier, or the columns ``keep`` and then __items and __overlap, which
    clash with no column of ``docs``.

    A window of two segments retrieves every item whose BM25 score is at least ``threshold`` times
    the item's score for itself. The item leaks if at least ``overlap`` of the three-word grams of
    its question, and of those of its answer, stand around the window. Words are runs of letters and
    digits, lower-cased. Items with fewer than ``least_words`` words, or null, prove nothing and are
    left out; repeated items are reported by their own ids. Null and empty texts leak nothing. An
    empty benchmark leaks nothing; an empty ``docs`` gives no rows.

    The index is broadcast in chunks whose texts have ``index_bytes`` at most on average, one pass
    over ``docs`` each, so a benchmark of any size is used whole. No document is shuffled.
    """
    spark = docs.sparkSession
    carried = keep or [ident]
    items = benchmark.select(F.col(item).cast("long").alias("id"), whole_text(item_text).alias("text"))
    size = items.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    chunks = max(1, -(-size // index_bytes))
    schema = docs.select(*carried).schema
    schema = schema.add("__items", T.ArrayType(T.LongType())).add("__overlap", "double")
    frame, source = docs.select(*carried), text
    if string_place(frame, text) is None:  # else the text travels once, with the row
        frame, schema, source = docs.select(*carried, whole_text(text).alias("__text")), schema.add("__text", "string"), "__text"
    for chunk in range(chunks):
        own = items if chunks == 1 else items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(chunks)) == chunk)
        known = sorted((r.id, r.text) for r in own.filter("id is not null").collect())
        # Pickled by value, so that executors need no copy of this package.
        index = spark.sparkContext.broadcast(cloudpickle.dumps(Index.of(known, least_words)))
        frame = frame.mapInArrow(lean(_searcher(index, threshold, overlap, chunk > 0, source)), schema)
    frame = frame.drop("__text") if source == "__text" else frame
    return frame if keep else frame.withColumnsRenamed({"__items": "items", "__overlap": "overlap"})


def _searcher(index, threshold: float, overlap: float, again: bool, source: str):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pickle.loads(index.value)
        beside = ["__text"] if source == "__text" else []
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                names = part.schema.names
                texts = [t or "" for t in part.column(names.index(source)).to_pylist()]
                found = leaks_in(texts, known, threshold, overlap)
                items = [sorted(known.item_ids[i] for i in f) for f in found]
                shares = [max(f.values(), default=None) for f in found]
                if again:
                    before = part.column(names.index("__items")).to_pylist()
                    items = [sorted(a + b) for a, b in zip(before, items, strict=True)]
                    old = part.column(names.index("__overlap")).to_pylist()
                    shares = [max((x for x in pair if x is not None), default=None) for pair in zip(old, shares, strict=True)]
                new = {"__items": pa.array(items, pa.list_(pa.int64())), "__overlap": pa.array(shares, pa.float64())}
                kept = [n for n in names if n not in ("__items", "__overlap", *beside)]
                columns = [part.column(names.index(n)) for n in kept] + [*new.values(), *(part.column(names.index(n)) for n in beside)]
                yield pa.record_batch(columns, names=[*kept, *new, *beside])

    return search


def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """The benchmark items that every document leaks."""
    found = find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", (F.size("items") > 0).alias("leaked"), "items", "overlap")
