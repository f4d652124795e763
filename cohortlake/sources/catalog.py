"""Stored tables: projected scans and the probe that picks the table to report on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def manifest_name(table: str) -> str:
    return f"{table}__features"


def require_rows(df: DataFrame, table: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"No rows found in table '{table}'")
    return df


def embeddings_table(spark: SparkSession, table: str = "embeddings") -> DataFrame:
    """``(seq_id, length, backend, dim, embedding)``; the older column name ``vec`` is accepted."""
    stored = spark.table(table)
    names = {c.lower(): c for c in stored.columns}
    vector = names.get("embedding") or names.get("vec")
    if vector is None:
        raise ValueError(f"No embedding/vec column found in table '{table}'")
    return stored.select("seq_id", "length", "backend", "dim", F.col(vector).alias("embedding"))


def feature_names(spark: SparkSession, table: str = "multiomics") -> list[str]:
    rows = spark.table(manifest_name(table)).orderBy("position").collect()
    return [r["feature"] for r in rows]


def features_table(spark: SparkSession, table: str = "multiomics") -> DataFrame:
    """``(sample_id, label, label_index, features, group_id)``."""
    return spark.table(table).select("sample_id", "label", "label_index", "features", "group_id")


def report_source(spark: SparkSession, features: str = "multiomics", embeddings: str = "embeddings") -> str:
    """``features`` when that table exists, else ``embeddings``; neither is an error."""
    if spark.catalog.tableExists(features):
        return "features"
    if spark.catalog.tableExists(embeddings):
        return "embeddings"
    raise ValueError(f"The catalog has neither '{features}' nor '{embeddings}'")
