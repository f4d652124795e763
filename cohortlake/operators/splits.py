"""Seeded splits: stratified train/test, per-class fractions and stratified group folds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlake.operators.ranking import seeded_key, stratum_rank
from cohortlake.session import checkpoint


def stratified_split(df: DataFrame, label: str, ident: str, test_size: float = 0.25, seed: int = 42) -> DataFrame:
    """Add ``part`` (``train`` or ``test``).

    The test part has ``ceil(n * test_size)`` rows, shared among the classes in proportion with the
    leftover rows going to the largest remainders. Fewer than four rows or a single class keep all
    rows in the training part.
    """
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    whole = Window.partitionBy()
    sizes = counts.withColumn("__total", F.sum("__n").over(whole)).withColumn(
        "__train", F.col("__total") - F.ceil(F.col("__total") * F.lit(test_size))
    )
    exact = F.col("__n") * F.col("__train") / F.col("__total")
    sizes = sizes.withColumn("__base", F.floor(exact)).withColumn("__rest", exact - F.col("__base"))
    by_rest = Window.orderBy(F.desc("__rest"), label)
    extra = (F.row_number().over(by_rest) <= F.col("__train") - F.sum("__base").over(whole)).cast("long")
    splittable = (F.col("__total") >= 4) & (F.count(F.lit(1)).over(whole) >= 2)
    quota = F.when(splittable, F.col("__base") + extra).otherwise(F.col("__n"))
    quotas = sizes.select(F.col(label).alias("__class"), quota.alias("__quota"))
    ranked = stratum_rank(df, [label], ident, seed)
    part = F.when(F.col("rank") <= F.col("__quota"), F.lit("train")).otherwise(F.lit("test"))
    # Null-safe: rows without a class are a class of their own.
    joined = ranked.join(quotas, F.col(label).eqNullSafe(F.col("__class")))
    return joined.withColumn("part", part).drop("rank", "stratum_size", "__class", "__quota")


def stratified_fraction(df: DataFrame, label: str, ident: str, fraction: float = 0.8, seed: int = 1337) -> DataFrame:
    """Add ``part``: the first ``max(1, round(n * fraction))`` rows per class are ``train``.

    Rounding is half to even.
    """
    ranked = stratum_rank(df, [label], ident, seed)
    quota = F.greatest(F.lit(1.0), F.bround(F.col("stratum_size") * F.lit(fraction)))
    return ranked.withColumn("part", F.when(F.col("rank") <= quota, F.lit("train")).otherwise(F.lit("heldout"))).drop(
        "rank", "stratum_size"
    )


def fold_count(df: DataFrame, label: str, group: str, desired: int) -> DataFrame:
    """One row: smallest class, number of groups and the usable number of folds."""
    classes = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    groups = df.select(group).distinct()
    facts = classes.agg(F.min("n").alias("min_class"), F.count(F.lit(1)).alias("classes")).withColumn(
        "groups", groups.agg(F.count(F.lit(1))).scalar()
    )
    if desired <= 2:
        return facts.withColumn("folds", F.lit(max(2, desired)).cast("long"))
    most = F.greatest(F.lit(2), F.least("min_class", "groups"))
    return facts.withColumn("folds", F.least(F.lit(desired), most).cast("long"))


def group_folds(df: DataFrame, label: str, group: str, folds: int, seed: int = 42) -> DataFrame:
    """``(group, fold)``: whole groups dealt to folds so that class mix and size stay balanced.

    Rows are first reduced to counts per (group, class). Each group belongs to its most frequent
    class (the smallest label on a tie); within a class, groups are dealt round robin from the
    largest to the smallest, equal sizes in seeded order.
    """
    counts = df.groupBy(group, label).agg(F.count(F.lit(1)).alias("n"))
    profile = counts.groupBy(group).agg(
        F.sum("n").alias("size"), F.min(F.struct((-F.col("n")).alias("n"), F.col(label).alias("c"))).alias("top")
    )
    profile = profile.select(group, "size", F.col("top.c").alias("main_class"))
    ranked = stratum_rank(profile, ["main_class"], group, seed, leading="size")
    return ranked.select(group, ((F.col("rank") - 1) % F.lit(folds)).cast("int").alias("fold"))


def balanced_group_folds(
    df: DataFrame, label: str, group: str, folds: int, seed: int = 42, share: float = 0.001
) -> DataFrame:
    """``(group, fold)``: whole groups dealt so that every fold holds about the same part of every class.

    A group that holds more than ``share / folds`` of some class is large; there are at most
    ``classes * folds / share`` of them, whatever the size of the table, and only they are placed one
    by one on the driver, the largest part of a class first: each goes where the squared class shares
    of the folds grow least. The others are dealt as in ``group_folds`` before, and their class counts
    are what the folds start with. Groups of equal counts go by seeded key. A null group is one group,
    a null label one class; an empty table gives no rows.
    """
    counts = checkpoint(df.groupBy(group, label).agg(F.count(F.lit(1)).alias("__n")))
    classes = counts.groupBy(F.col(label).alias("__class")).agg(F.sum("__n").alias("__total"))
    sized_counts = counts.join(classes, F.col(label).eqNullSafe(F.col("__class")))
    large = sized_counts.groupBy(group).agg(F.max(F.col("__n") / F.col("__total")).alias("__part"))
    large = large.select(F.col(group).alias("__group"), (F.col("__part") > share / folds).alias("__large"))
    marked = checkpoint(counts.join(large, F.col(group).eqNullSafe(F.col("__group"))).drop("__group"))
    # Counts per (group, label) weigh as rows, so the small groups are ranked as in group_folds.
    small = marked.filter(~F.col("__large"))
    profile = small.groupBy(group).agg(
        F.sum("__n").alias("__size"), F.min(F.struct((-F.col("__n")).alias("n"), F.col(label).alias("c"))).alias("__top")
    )
    profile = profile.select(group, "__size", F.col("__top.c").alias("__main"))
    ranked = stratum_rank(profile, ["__main"], group, seed, leading="__size")
    dealt = checkpoint(ranked.select(group, ((F.col("rank") - 1) % F.lit(folds)).cast("int").alias("fold")))

    totals = {r["__class"]: r["__total"] for r in classes.collect()}
    position = {c: i for i, c in enumerate(totals)}
    loads = np.zeros((folds, len(totals)))
    placed = dealt.withColumnRenamed(group, "__group")
    begun = small.join(placed, F.col(group).eqNullSafe(F.col("__group"))).groupBy("fold", label).agg(F.sum("__n").alias("__n"))
    for fold, name, n in begun.collect():
        loads[fold, position[name]] = n / totals[name]
    parts: dict[object, np.ndarray] = {}
    ordered = marked.filter("__large").select(group, label, "__n", seeded_key(seed, group).alias("__key"))
    keys: dict[object, str] = {}
    for name, of_class, n, key in ordered.collect():
        parts.setdefault(name, np.zeros(len(totals)))[position[of_class]] = n / totals[of_class]
        keys[name] = key or ""
    rows = []
    for name in sorted(parts, key=lambda g: (-parts[g].max(), -parts[g].sum(), keys[g])):
        # (load + part)^2 - load^2 summed over classes, up to a constant; the smallest fold on a tie
        fold = int(np.argmin(np.round(loads @ parts[name], 12)))
        loads[fold] += parts[name]
        rows.append((name, fold))
    schema = T.StructType([df.schema[group], T.StructField("fold", T.IntegerType())])
    return dealt.unionByName(df.sparkSession.createDataFrame(rows, schema))


def with_group_fold(df: DataFrame, label: str, group: str, folds: int, seed: int = 42) -> DataFrame:
    """``df`` with ``fold``; rows without a group are one group of their own."""
    dealt = group_folds(df, label, group, folds, seed).withColumnRenamed(group, "__group")
    return df.join(dealt, F.col(group).eqNullSafe(F.col("__group"))).drop("__group")
