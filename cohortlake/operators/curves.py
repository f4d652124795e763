"""Threshold curves: ROC area and average precision without a global sort in one task."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_RANGES = 1024


def threshold_counts(df: DataFrame, score: str, positive: str, groups: Sequence[str] = ()) -> DataFrame:
    """Per distinct score: positives and negatives at it, and totals at strictly higher scores.

    Null and NaN scores are missing; infinite scores are ordinary values at either end. Rows with
    equal scores collapse in the map-side aggregate, so a hot score costs nothing. The
    remaining distinct scores are split into value ranges by approximate quantiles; the running
    total is the total of the higher ranges plus the running total inside the range. Ranges only
    steer the parallelism, the counts are exact.
    """
    groups = list(groups)
    number = F.col(score).cast("double")
    df = df.filter(number.isNotNull() & ~F.isnan(number))
    cuts = df.select(
        F.percentile_approx(F.col(score).cast("double"), [i / _RANGES for i in range(1, _RANGES)], 10_000)
    ).first()[0]
    finite = {c for c in cuts or () if math.isfinite(c)} or {0.0}
    splits = [float("-inf"), *sorted(finite), float("inf")]
    counts = (
        df.groupBy(*groups, F.col(score).cast("double").alias("score"))
        .agg(
            F.sum(F.col(positive).cast("long")).alias("pos"),
            F.sum(1 - F.col(positive).cast("long")).alias("neg"),
        )
    )
    ranged = Bucketizer(splits=splits, inputCol="score", outputCol="__range").transform(counts)
    ranged = ranged.withColumn("__range", F.col("__range").cast("int"))
    higher = Window.partitionBy(*groups).orderBy(F.desc("__range"))
    totals = ranged.groupBy(*groups, "__range").agg(F.sum("pos").alias("__p"), F.sum("neg").alias("__n"))
    whole = Window.partitionBy(*groups)
    totals = totals.select(
        *groups,
        "__range",
        (F.sum("__p").over(higher) - F.col("__p")).alias("__p_before"),
        (F.sum("__n").over(higher) - F.col("__n")).alias("__n_before"),
        F.sum("__p").over(whole).alias("positives"),
        F.sum("__n").over(whole).alias("negatives"),
    )
    inside = Window.partitionBy(*groups, "__range").orderBy(F.desc("score"))
    return (
        ranged.join(totals, [*groups, "__range"])
        .withColumn("pos_above", F.col("__p_before") + F.sum("pos").over(inside) - F.col("pos"))
        .withColumn("neg_above", F.col("__n_before") + F.sum("neg").over(inside) - F.col("neg"))
        .select(*groups, "score", "pos", "neg", "pos_above", "neg_above", "positives", "negatives")
    )


def ranking_quality(df: DataFrame, score: str, positive: str, groups: Sequence[str] = ()) -> DataFrame:
    """``roc_auc`` (ties count one half) and ``average_precision`` (step sum over distinct scores).

    A group without positives or without negatives has no area: both values are null there.
    """
    curve = threshold_counts(df, score, positive, groups)
    at_least_p = F.col("pos_above") + F.col("pos")
    at_least_n = F.col("neg_above") + F.col("neg")
    pairs = F.sum(F.col("neg") * (F.col("pos_above") + F.col("pos") / F.lit(2.0)))
    area = pairs / F.nullif(F.max("positives").cast("double") * F.max("negatives"), F.lit(0.0))
    steps = F.sum(F.col("pos") * (at_least_p / (at_least_p + at_least_n)))
    both = (F.max("positives") > 0) & (F.max("negatives") > 0)
    return curve.groupBy(*groups).agg(
        area.alias("roc_auc"),
        F.when(both, steps / F.nullif(F.max("positives"), F.lit(0))).alias("average_precision"),
    )
