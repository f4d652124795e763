"""Line deduplication over whole documents, with compressed keep bitmaps instead of texts.

Lines become (128-bit hash, document, position) rows. The rows are dealt by hash ranges and sorted
by document and position, so the first row of a hash names the document that keeps the line; every
other document drops it. What travels back are run lengths per document, not lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlake.llm.common import BLANKS, lower_ascii, scratch_table, whole_text

ROW = ["doc_id", "text_hash"]


def line_key(line: Column) -> Column:
    """A line without the blanks at both ends and with A-Z lower-cased."""
    return lower_ascii(F.trim(line, F.lit(BLANKS)))


def identified(docs: DataFrame, text: str, ident: str) -> DataFrame:
    """The documents as (doc_id, text_hash, text); a null text is empty."""
    body = whole_text(text)
    return docs.select(F.col(ident).alias("doc_id"), F.xxhash64(body).alias("text_hash"), body.alias("text"))


def keep_bitmaps(
    docs: DataFrame,
    text: str = "text",
    ident: str = "doc_id",
    min_length: int = 10,
    hot_lines: int = 256,
    tracked: int = 4096,
) -> DataFrame:
    """(doc_id, text_hash, n_lines, n_dropped, runs) for each document that loses lines.

    ``runs`` is the run-length coded keep bitmap of the document's lines: the lengths of alternating
    runs, beginning with kept ones (possibly 0).

    Lines whose key has at least ``min_length`` code points stay only in the smallest ``ident``
    holding the key. Documents without an identifier come last: they lose lines that any identified
    document holds, and none among themselves. Rows with the same identifier count as one holder.
    Null and empty texts are one empty line, which always stays. An empty table gives no rows.

    Skew: a bounded sketch names the ``hot_lines`` most frequent lines. Their holders are found by
    a partial aggregate, which is broadcast (at most ``hot_lines`` keys); their rows are salted over
    the ranges. No range or window therefore meets more than 1/``tracked`` of all rows for one key.
    """
    rows = identified(docs, text, ident).select(*ROW, F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keyed = rows.select(*ROW, "pos", line_key(F.col("line")).alias("key")).filter(F.char_length("key") >= min_length)
    lines = keyed.select(*ROW, "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    # Split and hashed once: the sketch, the holders, the range sampling and the sort read hashes only.
    lines = scratch_table(lines, "lines")
    hot = lines.agg(F.expr(f"approx_top_k(h1, {hot_lines}, {tracked})").alias("top")).select(
        F.explode("top.item").alias("h1")
    )
    holders = lines.join(F.broadcast(hot), "h1").groupBy("h1", "h2").agg(F.min("doc_id").alias("holder"))
    salted = lines.join(F.broadcast(holders), ["h1", "h2"], "left").withColumn(
        "salt", F.when(F.col("holder").isNotNull(), F.xxhash64(*ROW, "pos")).otherwise(F.lit(0).cast("long"))
    )
    stream = Window.partitionBy("h1", "h2", "salt").orderBy(F.col("doc_id").asc_nulls_last(), "text_hash", "pos")
    first = F.coalesce("holder", F.first("doc_id").over(stream))
    dropped = (
        salted.repartitionByRange("h1", "h2", "salt")
        .withColumn("first", first)
        .filter(F.col("first").isNotNull() & (F.col("doc_id").isNull() | (F.col("first") < F.col("doc_id"))))
    )
    at = dropped.groupBy(*ROW).agg(F.array_sort(F.collect_set("pos")).alias("at"))
    return at.select(*ROW, F.size("at").cast("long").alias("n_dropped"), drop_runs(F.col("at")).alias("runs"))


def drop_runs(at: Column) -> Column:
    """Run lengths (kept, dropped, kept, dropped, ...) of sorted dropped positions."""
    last = F.size(at) - 1
    begins = F.filter(at, lambda p, i: (i == 0) | (F.get(at, i - 1) < p - 1))
    ends = F.filter(at, lambda p, i: (i == last) | (F.get(at, i + 1) > p + 1))
    bounds = F.arrays_zip(begins.alias("b"), ends.alias("e"), F.concat(F.array(F.lit(-1)), ends).alias("before"))
    runs = F.transform(
        F.filter(bounds, lambda r: r["b"].isNotNull()),
        lambda r: F.array(r["b"] - r["before"] - 1, r["e"] - r["b"] + 1),
    )
    return F.flatten(runs)


def kept_text(text: Column, runs: Column) -> Column:
    """The text without the lines that the bitmap drops; lines behind the last run stay."""
    keep = F.flatten(F.transform(runs, lambda n, i: F.array_repeat(i % 2 == 0, n)))
    marked = F.zip_with(F.split(text, "\n", -1), keep, lambda line, k: F.when(F.coalesce(k, F.lit(True)), line))
    return F.array_join(marked, "\n")


def dedup_lines(docs: DataFrame, text: str = "text", ident: str = "doc_id", **options: int) -> DataFrame:
    """Each document once per row of ``docs``: doc_id, n_lines, n_dropped, runs, kept (its text)."""
    whole = identified(docs, text, ident)
    maps = keep_bitmaps(docs, text, ident, **options).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "n_dropped", "runs")
    same = whole["doc_id"].eqNullSafe(maps["__id"]) & (whole["text_hash"] == maps["__hash"])
    return whole.join(maps, same, "left").select(
        "doc_id",
        F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"),
        "runs",
        F.when(F.col("runs").isNull(), F.col("text")).otherwise(kept_text(F.col("text"), F.col("runs"))).alias("kept"),
    )


def op2_line_dedup(spark, folder: str) -> DataFrame:
    """The line digest of every document."""
    from cohortlake.llm.common import table

    return dedup_lines(table(spark, folder, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256")
    )


OP2_SQL = """
WITH pieces AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS pieces FROM documents),
lines AS (
  SELECT doc_id, unnest(pieces) AS line, generate_subscripts(pieces, 1) AS pos FROM pieces),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
holders AS (
  SELECT key, min(doc_id) AS holder FROM keyed WHERE length(key) >= 10 GROUP BY key),
marked AS (
  SELECT k.*, coalesce(holder < doc_id, false) AS dropped FROM keyed k LEFT JOIN holders USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
