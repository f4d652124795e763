"""Attaching, encoding and weighting class labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlake.operators.quantiles import exact_median
from cohortlake.session import sized


def last_per_id(labels: DataFrame, ident: str, label: str, position: str) -> DataFrame:
    """One label per id: a repeated id keeps the label of its last row."""
    return labels.groupBy(ident).agg(F.max_by(label, position).alias(label))


def attach_labels(df: DataFrame, labels: DataFrame, ident: str) -> DataFrame:
    """Left join on the id; ``labels`` has one row per id, so no row is multiplied."""
    return df.join(labels, ident, "left")


def unlabelled(df: DataFrame, labels: DataFrame, ident: str) -> DataFrame:
    return df.select(ident).join(labels.select(ident), ident, "left_anti")


def require_labels(df: DataFrame, labels: DataFrame, ident: str) -> None:
    """Raise with the number and the first five of the ids that have no label."""
    missing = unlabelled(df, labels, ident)
    row = missing.agg(F.count(F.lit(1)).alias("n")).first()
    if row["n"]:
        first = [r[0] for r in missing.orderBy(ident).limit(5).collect()]
        raise ValueError(f"no label for {row['n']} of the {ident} values, the first being {first}")


def rule_label(df: DataFrame, length: str, rule: str = "median-length", out: str = "label") -> DataFrame:
    """Label by rule; ``median-length`` gives 1 to rows strictly longer than the median."""
    if rule != "median-length":
        raise ValueError(f"'{rule}' is not a labelling rule")
    return df.withColumn(out, (F.col(length) > exact_median(df, length)).cast("int"))


def label_index(df: DataFrame, label: str) -> DataFrame:
    """``(label, label_index)``: 0-based rank among the sorted distinct labels."""
    distinct = df.select(label).filter(F.col(label).isNotNull()).distinct()
    return distinct.withColumn("label_index", F.dense_rank().over(Window.orderBy(label)) - 1)


def encode_labels(df: DataFrame, label: str) -> DataFrame:
    """Add ``label_index`` (null for a null label).

    The class table is materialised first so that its size is known.
    """
    return df.join(sized(label_index(df, label)), label, "left")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """``(label, n, weight)`` with the balanced weight ``total / (classes * n)``."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    classes = counts.agg(F.count(F.lit(1))).scalar()
    return counts.withColumn("weight", total / (classes * F.col("n")))


def label_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), label)


def sorted_labels(df: DataFrame, label: str) -> list:
    """Distinct labels in order; classes are few by nature, and the result names model outputs."""
    return [r[0] for r in df.select(label).distinct().orderBy(label).collect()]


def weight_column(weights: Sequence[tuple], label: str) -> Column:
    """Weight lookup as a literal expression over the class list."""
    pairs = [x for value, weight in weights for x in (F.lit(value), F.lit(float(weight)))]
    return F.create_map(*pairs)[F.col(label)]
