"""Column expressions for sequence text and its annotations.

Jobs ship this module by value when their functions name it. A UDF holds on to the session once it
was used, and could not be shipped; so each call makes its own and none is kept in the module.
"""

from __future__ import annotations

import string
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlake.functions.vector import list_array

# The counted residue letters, the letters accepted in a cleaned sequence, and the
# width of the composition vector.
RESIDUES = "ACDEFGHIKLMNPQRSTVWY"
ACCEPTED = "ACDEFGHIKLMNPQRSTVWYXBZJ"
COMPOSITION_DIM = 64
HISTOGRAM_BYTES = 4 << 20

_REJECTED = "".join(sorted(set(string.ascii_uppercase) - set(ACCEPTED)))


def text_slices(column: pa.Array) -> Iterator[pa.Array]:
    """The texts in slices of bounded bytes and rows; a longer text is a slice of its own."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else []
    at = 0
    while at < len(column):
        end = int(np.searchsorted(offsets, offsets[at] + HISTOGRAM_BYTES, side="right")) - 1
        end = min(max(end, at + 1), at + 4096, len(column))
        yield column.slice(at, end - at)
        at = end


def byte_counts(texts: pa.Array) -> np.ndarray:
    """How often each of the 256 bytes occurs in each text; null texts have none."""
    filled = texts.fill_null("")
    offsets = np.frombuffer(filled.buffers()[1], dtype=np.int64)[filled.offset : filled.offset + len(filled) + 1]
    data = filled.buffers()[2]
    letters = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    row = np.repeat(np.arange(len(filled)), np.diff(offsets))
    return np.bincount(row * 256 + letters, minlength=256 * len(filled)).reshape(len(filled), 256)


def _compositions(sequence: pa.Array) -> pa.Array:
    wanted = np.frombuffer(RESIDUES.encode(), dtype=np.uint8)
    counts = np.concatenate([np.zeros((0, len(wanted))), *(byte_counts(p)[:, wanted] for p in text_slices(sequence))])
    norms = np.linalg.norm(counts, axis=1, keepdims=True)
    shares = np.divide(counts, norms, out=np.zeros_like(counts), where=norms > 0)
    tiled = shares[:, np.arange(COMPOSITION_DIM) % len(wanted)].astype(np.float32)
    return list_array(tiled)


def composition(sequence: Column) -> Column:
    """L2-normalised residue-count vector (case-sensitive), repeated cyclically up to 64 entries.

    A text without counted letters gives zeros. One histogram over (text, byte) of many texts at once
    replaces twenty ``replace`` passes in SQL.
    """
    return F.arrow_udf(_compositions, T.ArrayType(T.FloatType()))(sequence)


def accession(header: Column) -> Column:
    """Accession of a FASTA header: second field of ``sp|…`` / ``tr|…``, else the first token."""
    text = F.regexp_replace(F.regexp_replace(header, r"^\s+|\s+$", ""), "^>", "")
    fields = F.split(text, r"\|")
    curated = F.get(fields, F.lit(0)).isin("sp", "tr") & (F.size(fields) >= 2)
    return F.when(curated, F.get(fields, F.lit(1))).otherwise(F.regexp_extract(text, r"^\s*(\S*)", 1))


def top_enzyme_class(annotation: Column) -> Column:
    """Leading digit of the first ``;``-separated enzyme code, or null."""
    first = F.trim(F.split_part(annotation, F.lit(";"), F.lit(1)))
    digit = F.regexp_extract(first, r"^(\d)\.", 1)
    return F.nullif(digit, F.lit("")).try_cast("int")


def _letters(replace_rejected: bool) -> np.ndarray:
    """Byte table: upper case for letters (optionally ``X`` for rejected ones), 0 for dropped bytes."""
    table = np.zeros(256, dtype=np.uint8)
    for letter in string.ascii_uppercase:
        kept = "X" if replace_rejected and letter in _REJECTED else letter
        table[[ord(letter), ord(letter.lower())]] = ord(kept)
    return table


def _mapped_text(text: pa.Array, table: np.ndarray) -> pa.Array:
    """Map all bytes of a column through ``table`` at once and drop those mapped to 0."""
    text = text.cast(pa.large_string())
    _, offsets, data = text.buffers()
    if data is None:
        return pa.array([None if v is None else "" for v in text.to_pylist()], pa.string())
    bounds = np.frombuffer(offsets, dtype=np.int64)[text.offset : text.offset + len(text) + 1]
    mapped = table[np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]]]
    kept = np.concatenate([[0], np.cumsum(mapped != 0)])[bounds - bounds[0]]
    out = pa.LargeStringArray.from_buffers(len(text), pa.py_buffer(kept.astype(np.int64)), pa.py_buffer(mapped[mapped != 0]))
    return pc.if_else(text.is_valid(), out, None).cast(pa.string())


def _cleaned(sequence: Column, replace_rejected: bool) -> Column:
    def cleaned(text: pa.Array) -> pa.Array:
        return _mapped_text(text, _letters(replace_rejected))

    return F.arrow_udf(cleaned, T.StringType())(sequence)


def letters_only(sequence: Column) -> Column:
    """ASCII letters of the text in upper case."""
    return _cleaned(sequence, False)


def sanitized(sequence: Column) -> Column:
    """Like ``letters_only``, with letters outside the accepted alphabet replaced by ``X``."""
    return _cleaned(sequence, True)


def rejected_letters(letters: Column) -> Column:
    """Sorted distinct letters outside the accepted alphabet (input from ``letters_only``)."""
    return F.array_compact(F.array(*[F.when(F.contains(letters, F.lit(c)), F.lit(c)) for c in _REJECTED]))


def _overlaps_itself(pattern: str) -> bool:
    return any(pattern.startswith(pattern[k:]) for k in range(1, len(pattern)))


def match_count(text: Column, pattern: str) -> Column:
    """Number of start positions of ``pattern``, overlapping ones included; 0 when it is empty."""
    if not pattern:
        return F.lit(0)
    if _overlaps_itself(pattern):
        quoted = pattern.replace("\\E", "\\E\\\\E\\Q")
        return F.regexp_count(text, F.lit(f"(?=\\Q{quoted}\\E)"))
    removed = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(pattern), F.lit("")))
    return F.floor(removed / F.lit(len(pattern.encode()))).cast("int")


def _start_positions(text: pd.Series, pattern: pd.Series) -> pd.Series:
    def starts(t: str, p: str) -> list[int]:
        found, at = [], t.find(p)
        while at >= 0:
            found.append(at)
            at = t.find(p, at + 1)
        return found

    return pd.Series([starts(t, p) for t, p in zip(text, pattern)])


def pattern_positions(df: DataFrame, keys: Sequence[str], text: str, patterns: Sequence[str]) -> DataFrame:
    """Every 0-based start of every pattern in ``text``: one row per (keys, pattern, position).

    Rows without a hit are dropped on the JVM side; only texts that contain a pattern are sent to
    the Arrow helper, which runs in time linear in the text plus the number of hits.
    """
    wanted = [p for p in dict.fromkeys(patterns) if p]
    if not wanted:
        return df.select(*keys, F.lit("").alias("pattern"), F.lit(0).alias("position")).limit(0)
    present = F.array_compact(F.array(*[F.when(F.contains(F.col(text), F.lit(p)), F.lit(p)) for p in wanted]))
    hits = df.select(*keys, text, F.explode(present).alias("pattern"))
    positions = F.pandas_udf(_start_positions, T.ArrayType(T.IntegerType()))
    return hits.select(*keys, "pattern", F.explode(positions(F.col(text), F.col("pattern"))).alias("position"))
