"""Seeded, reproducible ranking inside strata of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded_key(seed: int, ident: str) -> Column:
    """Pseudo-random sort key of a row: stable across runs, partitionings and engines."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(ident).cast("string")))


def stratum_rank(
    df: DataFrame,
    strata: Sequence[str],
    ident: str,
    seed: int,
    leading: str | None = None,
    digits: int = 3,
) -> DataFrame:
    """Add ``rank`` (1-based, per stratum) and ``stratum_size``.

    The order is ``leading`` descending (when given), then the seeded key, then the identifier. A
    plain ``row_number`` over the stratum would sort a dominant stratum in a single task. Here the
    first ``digits`` hex digits of the key split each stratum into buckets: the rank is the number
    of rows in earlier buckets (from a small count table) plus the rank inside the bucket, which is
    the same number, computed in parallel.
    """
    lead = [leading] if leading else []
    # A struct key is never null, so rows without a class keep their own stratum.
    keyed = df.withColumn("__key", seeded_key(seed, ident)).withColumn(
        "__cell", F.struct(*strata, *lead, F.substring("__key", 1, digits).alias("__bucket"))
    )
    field = {c: F.col("__cell").getField(c) for c in [*strata, *lead, "__bucket"]}
    stratum = Window.partitionBy(*[field[c] for c in strata])
    before = stratum.orderBy(*[field[c].desc() for c in lead], field["__bucket"])
    offsets = (
        keyed.groupBy("__cell")
        .agg(F.count(F.lit(1)).alias("__rows"))
        .withColumn("__before", F.sum("__rows").over(before) - F.col("__rows"))
        .withColumn("stratum_size", F.sum("__rows").over(stratum))
        .drop("__rows")
    )
    inside = Window.partitionBy("__cell").orderBy("__key", ident)
    return (
        keyed.withColumn("__inside", F.row_number().over(inside))
        .join(offsets, "__cell")
        .withColumn("rank", F.col("__before") + F.col("__inside"))
        .drop("__key", "__cell", "__before", "__inside")
    )


def sample_per_class(df: DataFrame, label: str, ident: str, limit: int | None, seed: int) -> DataFrame:
    """Keep at most ``limit`` rows per class, chosen by the seeded key; ``None`` or 0 keeps all.

    ``row_number <= limit`` lets Catalyst prune each map task to ``limit`` rows per class before
    the shuffle (window group limit), so a dominant class never reaches one task whole.
    """
    if not limit or limit <= 0:
        return df
    order = Window.partitionBy(label).orderBy("__key", ident)
    return (
        df.withColumn("__key", seeded_key(seed, ident))
        .withColumn("__rank", F.row_number().over(order))
        .filter(F.col("__rank") <= limit)
        .drop("__key", "__rank")
    )
