"""Table appends, report files, FASTA and model parameter files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.sources.catalog import feature_names, manifest_name

EMBEDDING_COLUMNS = ["seq_id", "length", "backend", "dim", "embedding"]


def append_embeddings(df: DataFrame, table: str = "embeddings") -> None:
    """Create the table if needed and append, matching columns by name; partitioned by backend."""
    df.select(*EMBEDDING_COLUMNS).write.mode("append").partitionBy("backend").format("parquet").saveAsTable(table)


def write_features(df: DataFrame, features: list[str], table: str = "multiomics", overwrite: bool = False) -> None:
    """Store ``(sample_id, label, label_index, features, group_id)`` and the feature order once.

    The names live in a one-row-per-feature side table. Appending rows with other features or
    another order is an error, so all rows of a table share one layout.
    """
    spark = df.sparkSession
    appending = spark.catalog.tableExists(table) and not overwrite
    if appending and feature_names(spark, table) != features:
        raise ValueError(f"Feature order differs from table '{table}'; overwrite it or ingest the same features")
    rows = df.withColumn("group_id", F.coalesce("group_id", "sample_id")).select(
        "sample_id", "label", "label_index", "features", "group_id"
    )
    rows.write.mode("overwrite" if overwrite else "append").format("parquet").saveAsTable(table)
    if not appending:  # last, so that a job that fails before leaves the old names with the old rows
        names = spark.createDataFrame(list(enumerate(features)), "position int, feature string")
        names.coalesce(1).write.mode("overwrite").format("parquet").saveAsTable(manifest_name(table))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_fasta(df: DataFrame, path: str, ident: str = "accession", sequence: str = "sequence") -> None:
    """``>id`` and the sequence on the next line."""
    df.select(F.concat(F.lit(">"), F.col(ident), F.lit("\n"), F.col(sequence)).alias("value")).write.mode(
        "overwrite"
    ).text(path)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """Store one small document, such as a metrics object."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
