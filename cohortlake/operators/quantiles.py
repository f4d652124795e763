"""Exact, interpolated quantiles that never hold a group's values in one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlake.session import sized

# Parts that each interval between two bracket ends is cut into for ranking.
_PARTS = 256


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    groups: Sequence[str] = (),
    few_groups: bool = False,
    accuracy: int = 10_000,
) -> DataFrame:
    """One row per group: ``n`` and ``quantiles array<double>`` (linear interpolation, as given in ``probs``).

    ``percentile`` keeps every distinct value of a group in one hash map. Here a fixed-size
    quantile sketch brackets each probability within a narrow value interval; values inside an
    interval are counted individually, all others are only counted per gap between intervals.
    What remains per group, about 4/accuracy of its distinct values per probability, is ranked in
    two levels: totals of ``_PARTS`` equal-width parts of each interval, then the values inside a
    part, so no window holds a group. The order statistics are exact at any size and by one path; a
    bracket that misses its rank raises instead of returning a near value.

    ``few_groups`` says that there are few groups (one per feature column); the sketch table is then
    materialised, so that it is broadcast if its measured size allows.
    """
    groups = list(groups)
    data = df.select(*groups, F.col(value).cast("double").alias("__v")).filter(
        F.col("__v").isNotNull() & ~F.isnan("__v")
    )
    slack = 2.0 / accuracy
    lows = [max(0.0, p - slack) for p in probs]
    highs = [min(1.0, p + slack) for p in probs]
    sketch = data.groupBy(*groups).agg(
        F.count("__v").alias("__rows"),
        F.percentile_approx("__v", lows + highs, accuracy).alias("__ends"),
    )

    k = len(probs)
    if groups:
        data = data.join(sized(sketch) if few_groups else sketch, groups)
    else:
        whole = sketch.select(F.struct("__rows", "__ends")).scalar()
        data = data.withColumn("__s", whole).select("__v", "__s.*")
    low = [F.col("__ends")[i] for i in range(k)]
    high = [F.col("__ends")[k + i] for i in range(k)]
    v = F.col("__v")
    inside = reduce(lambda a, b: a | b, [(v >= low[i]) & (v <= high[i]) for i in range(k)])
    gap = sum([(v > e).cast("int") for e in low + high], F.lit(0))
    # The part is monotone in the value and only steers how many tasks share the ranking.
    ends = F.array_sort("__ends")
    data = data.select(*groups, "__v", inside.alias("__in"), gap.alias("__gap"), ends.alias("__sorted"))
    from_end = F.get("__sorted", F.col("__gap") - 1)
    share = (v - from_end) / F.nullif(F.get("__sorted", F.col("__gap")) - from_end, F.lit(0.0))
    part = F.when(F.col("__in"), F.least(F.lit(_PARTS - 1), F.floor(share * _PARTS)))
    cells = (
        data.withColumn("__part", F.coalesce(part, F.lit(0)).cast("int"))
        .groupBy(*groups, "__gap", "__part", F.when(F.col("__in"), F.col("__v")).alias("__exact"))
        .agg(
            F.count(F.lit(1)).alias("__c"),
            F.min("__v").alias("__min"),
            F.max("__v").alias("__max"),
        )
    )
    spot = [*groups, "__gap", "__part"]
    totals = cells.groupBy(*spot).agg(F.sum("__c").alias("__t"))
    by = Window.partitionBy(*groups)
    totals = totals.select(
        *spot, (F.sum("__t").over(by.orderBy("__gap", "__part")) - F.col("__t")).alias("__before"), F.sum("__t").over(by).alias("n")
    )
    ranked = cells.join(totals, spot).withColumn(
        "__upto", F.col("__before") + F.sum("__c").over(Window.partitionBy(*spot).orderBy("__max"))
    )

    def at(rank: Column) -> Column:
        start = F.col("__upto") - F.col("__c")
        value_at = (
            F.when(F.col("__exact").isNotNull(), F.col("__exact"))
            .when(rank == start, F.col("__min"))
            .when(rank == F.col("__upto") - 1, F.col("__max"))
            .otherwise(F.raise_error(F.lit("quantile bracket missed its rank; raise accuracy")).cast("double"))
        )
        return F.max(F.when((start <= rank) & (rank < F.col("__upto")), value_at))

    picks = []
    for i, p in enumerate(probs):
        position = (F.col("n") - 1) * F.lit(float(p))
        picks += [at(F.floor(position)).alias(f"__lo{i}"), at(F.ceil(position)).alias(f"__hi{i}")]
    out = ranked.groupBy(*groups).agg(F.max("n").alias("n"), *picks)
    parts = []
    for i, p in enumerate(probs):
        position = (F.col("n") - 1) * F.lit(float(p))
        lo, hi = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        parts.append(lo + (hi - lo) * (position - F.floor(position)))
    return out.select(*groups, "n", F.array(*parts).alias("quantiles"))


def exact_median(df: DataFrame, value: str) -> Column:
    """Median of one column as a scalar subquery, usable in any expression."""
    return exact_quantiles(df, value, [0.5]).select(F.col("quantiles")[0]).scalar()
