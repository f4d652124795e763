"""FASTA scans: splittable, one pass over the text, no driver loop."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.functions.sequence import accession, letters_only
from cohortlake.session import sized

_EDGES = r"^\s+|\s+$"


def fasta_chunks(spark: SparkSession, paths: str | Sequence[str], header_first: bool = False) -> DataFrame:
    """Text between header marks, as ``(path, block, seq, chunk, first)``.

    The reader cuts records at a line break followed by ``>``, which lets one file be read by many
    tasks. The cut removes the ``>`` of every record but a file's first, so the first record must be
    told apart: it may hold text that precedes any header. It is the lowest row number of block 0
    and is found by a second scan that returns one row per file. ``header_first`` states that every
    file starts with a header and saves that scan.
    """
    text = (
        spark.read.option("lineSep", "\n>")
        .text(paths)
        .select(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("seq"),
            F.col("value").alias("chunk"),
        )
    )
    if header_first:
        starts = (F.col("block") == 0) & F.startswith("chunk", F.lit(">"))
        return text.withColumn("first", starts)
    heads = text.filter(F.col("block") == 0).groupBy("path").agg(F.min("seq").alias("seq"))
    heads = sized(heads.withColumn("first", F.lit(True)))
    return text.join(heads, ["path", "seq"], "left").withColumn(
        "first", F.coalesce("first", F.lit(False))
    )


def _records(chunks: DataFrame, header_break: str) -> DataFrame:
    """One row per record text (header line and body), without the text before a file's first header."""
    marked = F.concat(F.when(F.col("first"), F.lit("\n")).otherwise(F.lit("\n>")), F.col("chunk"))
    parts = F.split(marked, header_break)
    return chunks.select(
        "path", "block", "seq", F.posexplode(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).alias("part", "record")
    )


def _header(record: Column) -> Column:
    return F.regexp_extract(record, r"^([^\r\n]*)", 1)


def _body(record: Column) -> Column:
    return F.regexp_extract(record, r"^[^\r\n]*(?:\r\n|\r|\n)?([\s\S]*)$", 1)


def read_fasta(
    spark: SparkSession, paths: str | Sequence[str], header_first: bool = False, ordered: bool = False
) -> DataFrame:
    """``(seq_id, sequence)``: id = first word of the header, trimmed lines joined unchanged.

    ``ordered`` adds ``file_order`` (path, block, row, part), which sorts records as the files have them.

    An indented ``>`` also starts a record, blank lines vanish, empty sequences stay. A header
    without an id is an error when the row is read.
    """
    records = _records(fasta_chunks(spark, paths, header_first), r"(?:\r\n|\r|\n)[ \t\x0B\f]*>")
    ident = F.regexp_extract(_header(F.col("record")), r"^\s*(\S+)", 1)
    checked = F.when(ident == "", F.raise_error(F.lit("FASTA header without an identifier")).cast("string")).otherwise(ident)
    joined = F.regexp_replace(_body(F.col("record")), r"[ \t\x0B\f]*[\r\n]+[ \t\x0B\f]*", "")
    place = [F.struct("path", "block", "seq", "part").alias("file_order")] if ordered else []
    return records.select(checked.alias("seq_id"), F.regexp_replace(joined, _EDGES, "").alias("sequence"), *place)


def read_clean_fasta(spark: SparkSession, paths: str | Sequence[str], header_first: bool = False) -> DataFrame:
    """``(accession, sequence)`` with letters only, upper case.

    Only ``>`` in the first column starts a record; a record without any sequence line is dropped.
    """
    records = _records(fasta_chunks(spark, paths, header_first), r"(?:\r\n|\r|\n)>")
    body = _body(F.col("record"))
    has_line = F.regexp_like(F.col("record"), F.lit(r"^[^\r\n]*(?:\r\n|\r|\n)[\s\S]"))
    return records.filter(has_line).select(
        accession(_header(F.col("record"))).alias("accession"),
        letters_only(body).alias("sequence"),
    )
