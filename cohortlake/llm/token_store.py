"""Token ids of whole documents in a compact binary format, and reading them back.

A store is a Parquet dataset whose rows are segments: complete images of up to about ``SEGMENT`` ids
with their document table, block offsets and 64-bit words (``simple8b``). Spark's writer commits the
segments, so a store on any file system survives lost executors, and no task holds more than one
segment or one document.
"""

from __future__ import annotations

import re
import struct
import sys
import uuid
import zlib
from collections.abc import Iterator
from itertools import islice
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlake.llm import simple8b
from cohortlake.llm.common import lean, table, whole_text
from cohortlake.session import shared_folder

SEGMENT = 1 << 20
CODED_BYTES = 2 << 20  # of text coded at a time
CACHED_WORDS = 400_000
# ASCII marks that the vocabulary takes together when they follow letters; an apostrophe may not.
MARKS = """.,!?:;"#$%&()*+-/<=>@[\\]^_`{|}~"""
# Words that are letters for every Unicode version, with lower-case forms that are letters as well.
LETTERS = r"\A[A-Za-zÀ-ÖØ-öø-ÿ]+\z"
# Kinds of words: of these letters, of letters of any kind, of anything.
LATIN, OTHER, MIXED = range(3)
# Fixed values of the format: magic, documents, ids, words, escapes.
MAGIC = b"S8B1"
HEADER = "<4sIQQQ"
STORE_SCHEMA = "file_no int, segment int, first long, n_tokens long, image binary"
DOCS_SCHEMA = "file_no int, doc_id long, local_start long, n_tokens long, ids_crc32 long"


def pack_segment(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """One segment image: header, document ids, their null flags, lengths, block offsets, words."""
    words, offsets, escapes = simple8b.encode(ids)
    flags = np.array([d is None for d in doc_ids], dtype=np.uint8)
    numbers = np.array([d or 0 for d in doc_ids], dtype="<i8")
    head = struct.pack(HEADER, MAGIC, len(doc_ids), len(ids), len(words), escapes)
    parts = (numbers, flags, np.array(lengths, dtype="<i8"), offsets.astype("<u4"), words.astype("<u8"))
    return head + b"".join(p.tobytes() for p in parts)


def unpack_segment(image: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document ids, lengths, ids) of a segment image."""
    magic, docs, total, n_words, escapes = struct.unpack_from(HEADER, image)
    if magic != MAGIC:
        raise ValueError("not a token segment")
    at = struct.calcsize(HEADER)

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        part = np.frombuffer(image, dtype=kind, count=n, offset=at)
        at += part.nbytes
        return part

    numbers, flags, lengths = take("<i8", docs), take("u1", docs), take("<i8", docs)
    offsets, words = take("<u4", -(-total // simple8b.BLOCK)), take("<u8", n_words)
    ids = simple8b.decode(words, offsets.astype(np.int64), total, escapes)
    return [None if f else int(d) for d, f in zip(numbers, flags, strict=True)], lengths, ids


def gathered(table: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The runs of ``counts`` entries of ``table`` from ``first`` on, one behind the other."""
    total = int(counts.sum(dtype=np.int64))
    kind = np.int32 if max(total, len(table)) < 2**31 else np.int64
    shift = first.astype(kind) - (np.cumsum(counts, dtype=kind) - counts.astype(kind))
    return table[np.arange(total, dtype=kind) + np.repeat(shift, counts)]


def runs(texts: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """(first, number) of neighbouring rows; each run ends with the row that fills ``size`` bytes."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(ends):
        full = (ends[at - 1] if at else 0) + size
        after = min(len(ends), int(np.searchsorted(ends, full)) + 1)
        yield at, after - at
        at = after


def strings(values: pa.Array) -> list[str]:
    """The values, a great deal faster than one by one."""
    return values.to_numpy(zero_copy_only=False).tolist()


def opened(path: str) -> tuple:
    """A vocabulary's tokenizer, the same for words of ``LETTERS`` alone, and which ids close a word.

    Between spaces such words are not split, hold no white space and are composed already; so the
    second one, on the same model, cuts at spaces and lowers letters instead of matching expressions.
    """
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    tokenizer = Tokenizer.from_file(path)
    latin = Tokenizer(tokenizer.model)
    latin.normalizer = normalizers.Lowercase()
    latin.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
    )
    vocabulary = tokenizer.get_vocab()
    closes = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
    closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
    return tokenizer, latin, closes


class WordCoder:
    """Ids of texts through a table of words.

    Pieces between spaces and line feeds never share a token in a vocabulary that drops white space,
    so each different piece of a batch is looked up once. Letters and the marks behind them are
    encoded apart, as the vocabulary's own split does, and ASCII pieces in lower case; what the table
    lacks is encoded. The opened vocabulary and the table live as long as the worker process; the
    table is trimmed when it passes ``bound``.
    """

    def __init__(self, path: str, bound: int = CACHED_WORDS):
        tables = sys.modules.setdefault("_corpus_words", ModuleType("_corpus_words")).__dict__
        if path not in tables:
            tables[path] = (*opened(path), {"": b""})
        self.tokenizer, self.latin, self.closes, self.known = tables[path]
        self.bound = bound

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and the number of ids of each."""
        pieces = pc.split_pattern(pc.replace_substring(texts, pattern="\n", replacement=" "), pattern=" ")
        words = pieces.flatten().dictionary_encode()
        table, sizes = self._coded(words.dictionary)
        index = words.indices.to_numpy()
        counts = sizes[index]
        ids = gathered(table, (np.cumsum(sizes) - sizes)[index], counts)
        bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])[pieces.offsets.to_numpy()]
        return ids, np.diff(bounds)

    def trim(self) -> None:
        """Keep what was learned first, which the common words are, and release the rest."""
        first = list(islice(self.known.items(), self.bound // 8))
        self.known.clear()
        self.known.update(first)

    def _coded(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all different ``pieces``, and the number of ids of each."""
        if len(self.known) > self.bound:
            self.trim()
        plain = pc.if_else(pc.string_is_ascii(pieces), pc.ascii_lower(pieces), pieces)
        cores = pc.ascii_rtrim(plain, characters=MARKS)
        latin = pc.match_substring_regex(cores, pattern=LETTERS).to_numpy(zero_copy_only=False)
        fine, odd = latin.copy(), np.nonzero(~latin)[0]
        fine[odd] = [c.isalpha() and c.lower().isalpha() for c in cores.take(pa.array(odd)).to_pylist()]
        words = pc.if_else(pa.array(fine), cores, pieces).dictionary_encode()
        word = words.indices.to_numpy()
        kinds = np.full(len(words.dictionary), MIXED)
        kinds[word] = np.where(latin, LATIN, np.where(fine, OTHER, MIXED))
        marked = np.nonzero(fine & (pc.binary_length(plain).to_numpy() > pc.binary_length(cores).to_numpy()))[0]
        run = pc.extract_regex(plain.take(pa.array(marked)), pattern=f"(?P<marks>[{re.escape(MARKS)}]+)\\z")
        marks = run.field("marks").dictionary_encode()
        coded = self._ids(strings(words.dictionary), kinds) + self._ids(strings(marks.dictionary))
        lengths = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded)) // 4
        first = np.cumsum(lengths) - lengths
        # A word, and the marks behind it if there are any.
        counts, begins = np.zeros((2, len(pieces), 2), dtype=np.int64)
        counts[:, 0], begins[:, 0] = lengths[word], first[word]
        at = marks.indices.to_numpy() + len(kinds)
        counts[marked, 1], begins[marked, 1] = lengths[at], first[at]
        table = np.frombuffer(b"".join(coded), dtype="<u4")
        return gathered(table, begins.reshape(-1), counts.reshape(-1)), counts.sum(axis=1)

    def _ids(self, words: list[str], kinds: np.ndarray | None = None) -> list[bytes]:
        """The ids of each of ``words``; ``kinds`` tells which have nothing but letters."""
        known = self.known
        coded = list(map(known.get, words))
        new = [k for k, found in enumerate(coded) if found is None]
        kind = np.full(len(new), MIXED) if kinds is None else kinds[new]
        for which, tokenizer in ((LATIN, self.latin), (OTHER, self.tokenizer)):
            plain = [new[k] for k in np.nonzero(kind == which)[0].tolist()]
            for at in range(0, len(plain), 20_000):
                # Each word of letters closes with exactly one word-end token, so many encode as one text.
                some = [words[k] for k in plain[at : at + 20_000]]
                found = tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)
                ids = np.array(found[0].ids, dtype="<u4")
                ends = (4 * (np.nonzero(self.closes[ids])[0] + 1)).tolist()
                joined = ids.tobytes()
                known.update(zip(some, [joined[b:e] for b, e in zip([0, *ends[:-1]], ends, strict=True)], strict=True))
        rest = [words[new[k]] for k in np.nonzero(kind == MIXED)[0].tolist()]
        for at in range(0, len(rest), 20_000):
            some = rest[at : at + 20_000]
            found = self.tokenizer.encode_batch_fast(some, add_special_tokens=False)
            known.update(zip(some, (np.array(c.ids, dtype="<u4").tobytes() for c in found), strict=True))
        for k in new:
            coded[k] = known[words[k]]
        return coded


def write_tokens(
    docs: DataFrame, path: str, vocabulary: str, end_id: int = 1, text: str = "text", ident: str = "doc_id"
) -> None:
    """Encode every whole text and write the ids, each document closed by ``end_id``, to ``path``.

    Documents are dealt by ranges of ``ident`` and sorted, so files and segments follow its order
    (null identifiers first; rows with the same identifier in the order of their texts). Null texts
    are empty and give the end id alone. An empty table gives an empty store.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Arrow's other pools keep what they free, which counts against the executor.
        pa.set_memory_pool(pa.system_memory_pool())
        coder, file_no = WordCoder(vocabulary), TaskContext.get().partitionId()
        ids, numbers, lengths, held, first, segment = [], [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal held, first, segment
            image = pack_segment(numbers, lengths, np.concatenate(ids))
            row = ([file_no], [segment], [first], [held], [image])
            types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            batch = pa.record_batch(
                [pa.array(v, t) for v, t in zip(row, types, strict=True)],
                names=["file_no", "segment", "first", "n_tokens", "image"],
            )
            first, segment, held = first + held, segment + 1, 0
            ids.clear(), numbers.clear(), lengths.clear()
            return batch

        for batch in batches:
            for at, rows in runs(batch.column(1), CODED_BYTES):
                part = batch.slice(at, rows)
                coded, sizes = coder.encode(part.column(1))
                ends = np.cumsum(sizes)
                closed = np.insert(coded, ends, end_id)
                sizes, ends = (sizes + 1).tolist(), (ends + np.arange(1, len(ends) + 1)).tolist()
                for doc_id, n, e in zip(part.column(0).to_pylist(), sizes, ends, strict=True):
                    ids.append(closed[e - n : e])
                    numbers.append(doc_id)
                    lengths.append(n)
                    held += n
                    if held >= SEGMENT:
                        yield flush()
        if numbers:
            yield flush()
        coder.trim()

    ordered = docs.select(F.col(ident).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    ordered = ordered.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(lean(encode), STORE_SCHEMA).write.mode("overwrite").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of a store, decoded from its files.

    ``start`` counts the ids of all documents before it: those of its file from the segments, those
    of earlier files from one total per file.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                file_no, first, image = (batch.column(k)[at].as_py() for k in range(3))
                doc_ids, lengths, ids = unpack_segment(image)
                coded, ends = ids.astype("<u4").tobytes(), np.cumsum(lengths)
                begins = ends - lengths
                sums = [zlib.crc32(coded[4 * b : 4 * e]) for b, e in zip(begins, ends, strict=True)]
                yield pa.record_batch(
                    [
                        pa.array([file_no] * len(doc_ids), pa.int32()),
                        pa.array(doc_ids, pa.int64()),
                        pa.array(begins + first, pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array(sums, pa.int64()),
                    ],
                    names=["file_no", "doc_id", "local_start", "n_tokens", "ids_crc32"],
                )

    store = spark.read.schema(STORE_SCHEMA).parquet(path)
    totals = store.groupBy("file_no").agg(F.sum("n_tokens").alias("ids"))
    before = totals.select("file_no", (F.sum("ids").over(Window.orderBy("file_no")) - F.col("ids")).alias("before"))
    decoded = store.select("file_no", "first", "image").mapInArrow(lean(decode), DOCS_SCHEMA)
    return decoded.join(before, "file_no").select(
        "doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32"
    )


def tokenized(docs: DataFrame, vocabulary: str, **options) -> DataFrame:
    """Write the documents to a new store in the shared folder and read it back."""
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, vocabulary, **options)
    return read_tokens(spark, path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_token_store(spark: SparkSession, folder: str) -> DataFrame:
    """Place, length and checksum of every document's ids, read back from the written files."""
    return tokenized(table(spark, folder, "documents"), default_vocabulary())
