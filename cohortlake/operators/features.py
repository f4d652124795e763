"""Operators on wide numeric feature columns and feature vectors."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlake.operators.neighbours import neighbour_information
from cohortlake.operators.quantiles import exact_quantiles
from cohortlake.session import checkpoint, sized


def quoted(name: str) -> Column:
    """Column by literal name; feature names may contain dots and bars."""
    return F.col("`" + name.replace("`", "``") + "`")


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Numeric and boolean columns in table order, without the excluded ones."""
    kinds = (T.NumericType, T.BooleanType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds) and f.name not in set(exclude)]


def coerced(value: Column) -> Column:
    """Number, or null for text that is no number, infinities and NaN."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < F.lit(float("inf"))), number)


def coerce_numeric(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.withColumns({f: coerced(quoted(f)) for f in features})


def to_long(df: DataFrame, features: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """One row per (keys, feature, value)."""
    wide = df.select(*[quoted(k) for k in keys], *[quoted(f).cast("double").alias(f) for f in features])
    return wide.unpivot([quoted(k) for k in keys], [quoted(f) for f in features], "feature", "value")


def vector_to_long(df: DataFrame, vector: str, keys: Sequence[str] = ()) -> DataFrame:
    """One row per (keys, position, value)."""
    return df.select(*keys, F.posexplode(F.col(vector).cast("array<double>")).alias("position", "value"))


def named_long(df: DataFrame, vector: str, names: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """``vector_to_long`` with the feature name instead of its position."""
    name = F.get(F.array(*[F.lit(n) for n in names]), F.col("position"))
    return vector_to_long(df, vector, keys).select(*keys, name.alias("feature"), "value")


# --- statistics -----------------------------------------------------------------------------


def class_feature_stats(long: DataFrame, label: str) -> DataFrame:
    """Mean and population deviation of every feature per class, from ``(label, feature, value)`` rows."""
    return long.groupBy(label, "feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def overall_feature_stats(long: DataFrame) -> DataFrame:
    """Mean, sample deviation, minimum and maximum of every feature, from ``(feature, value)`` rows."""
    return long.groupBy("feature").agg(
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )


def wide_class_table(stats: DataFrame, label: str, features: Sequence[str], value: str) -> DataFrame:
    """Class rows by feature columns, the layout of the report tables."""
    return stats.groupBy(label).pivot("feature", list(features)).agg(F.first(value)).orderBy(label)


def feature_correlation(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Pearson correlation of every ordered feature pair as ``(feature_a, feature_b, corr)``.

    Each pair uses the rows in which both values are present; NaN counts as missing. A pair without
    two rows, or with a constant side, has a null correlation. Every task adds up one matrix of
    moments, whose size depends on the number of features only, and the sums meet per pair.
    """
    names, n = list(features), len(features)
    if not n:
        return df.sparkSession.createDataFrame([], "feature_a string, feature_b string, corr double")
    numbers = [F.nanvl(quoted(f).cast("double"), F.lit(None).cast("double")) for f in names]
    # Values are taken from the overall mean first, which keeps the sums of squares exact enough.
    centre = df.agg(F.array(*[F.coalesce(F.avg(x), F.lit(0.0)) for x in numbers]).alias("m")).scalar()
    rows = df.select(F.array(*numbers).alias("v"), centre.alias("m"))
    rows = rows.select(F.zip_with("v", "m", lambda x, m: x - m).alias("v"))

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((6, n, n))
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.column(0).slice(at, 4096)
                x = part.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, n)
                there = (~np.isnan(x)).astype(float)
                x = np.nan_to_num(x)
                sums += (there.T @ there, x.T @ there, there.T @ x, (x * x).T @ there, there.T @ (x * x), x.T @ x)
        at = np.arange(n)
        columns = [np.repeat(at, n), np.tile(at, n), *sums.reshape(6, -1)]
        yield pa.record_batch([pa.array(c) for c in columns], names=["a", "b", *_MOMENTS])

    schema = "a long, b long, " + ", ".join(f"{m} double" for m in _MOMENTS)
    pairs = rows.mapInArrow(moments, schema).groupBy("a", "b").agg(*[F.sum(m).alias(m) for m in _MOMENTS])
    c = {m: F.col(m) for m in _MOMENTS}
    # Multiplied by the number of rows; a side whose spread is rounding only is constant.
    xx, yy = c["n"] * c["xx"] - c["x"] * c["x"], c["n"] * c["yy"] - c["y"] * c["y"]
    spread = (xx > c["n"] * c["xx"] * 1e-13) & (yy > c["n"] * c["yy"] * 1e-13) & (c["n"] >= 2)
    corr = F.when(spread, (c["n"] * c["xy"] - c["x"] * c["y"]) / F.sqrt(xx * yy))
    name = F.array(*[F.lit(f) for f in names])
    return pairs.select(
        F.get(name, F.col("a").cast("int")).alias("feature_a"), F.get(name, F.col("b").cast("int")).alias("feature_b"), corr.alias("corr")
    )


_MOMENTS = ("n", "x", "y", "xx", "yy", "xy")


def vector_correlation(df: DataFrame, vector: str, names: Sequence[str]) -> DataFrame:
    """``feature_correlation`` of a vector column; an entry that a vector lacks is missing."""
    entries = [F.get(vector, F.lit(i)).cast("double").alias(name) for i, name in enumerate(names)]
    return feature_correlation(df.select(*entries), names)


def equal_width_histogram(df: DataFrame, value: str) -> DataFrame:
    """Counts per bin with ``min(30, max(5, floor(sqrt(n))))`` bins; the last bin is closed."""
    number = F.col(value).cast("double")
    shape = df.agg(F.min(number).alias("lo"), F.max(number).alias("hi"), F.count(number).alias("n"))
    bins = F.least(F.lit(30), F.greatest(F.lit(5), F.floor(F.sqrt("n")))).cast("int")
    # One distinct value gets a unit-wide range centred on it.
    flat = F.col("hi") == F.col("lo")
    shape = shape.select(
        F.struct(
            F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
            F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
            bins.alias("bins"),
        ).alias("s")
    )
    placed = df.filter(number.isNotNull()).select(number.alias("x"), shape.scalar().alias("s")).select("x", "s.*")
    width = (F.col("hi") - F.col("lo")) / F.col("bins")
    spot = F.least(F.floor((F.col("x") - F.col("lo")) / width).cast("int"), F.col("bins") - 1)
    counts = placed.groupBy(spot.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    empty = shape.select(F.explode(F.sequence(F.lit(0), F.col("s.bins") - 1)).alias("bin"), F.lit(0).cast("long").alias("count"))
    return (
        empty.unionByName(counts)
        .groupBy("bin")
        .agg(F.sum("count").alias("count"))
        .select("bin", shape.scalar().alias("s"), "count")
        .select(
            "bin",
            (F.col("s.lo") + F.col("bin") * ((F.col("s.hi") - F.col("s.lo")) / F.col("s.bins"))).alias("left_edge"),
            "count",
        )
    )


# --- imputation, selection, scaling ---------------------------------------------------------


def feature_medians(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """``(feature, n, median)``; a feature without any value has no row."""
    table = exact_quantiles(to_long(df, features), "value", [0.5], ["feature"], few_groups=True)
    return table.select("feature", "n", F.col("quantiles")[0].alias("median"))


def impute(df: DataFrame, medians: Mapping[str, float]) -> DataFrame:
    """Fill nulls with the fitted medians; features without one stay null."""
    return df.withColumns({f: F.coalesce(quoted(f).cast("double"), F.lit(float(m))) for f, m in medians.items()})


def fit_medians(df: DataFrame, features: Sequence[str]) -> dict[str, float]:
    return {r["feature"]: r["median"] for r in feature_medians(df, features).collect()}


def feature_variances(df: DataFrame, features: Sequence[str], min_variance: float) -> DataFrame:
    """``(feature, variance, kept)`` with sample variance; null variance counts as not kept."""
    variance = to_long(df, features).groupBy("feature").agg(F.var_samp("value").alias("variance"))
    return variance.withColumn("kept", F.coalesce(F.col("variance") > F.lit(float(min_variance)), F.lit(False)))


def select_varying(df: DataFrame, features: Sequence[str], min_variance: float) -> tuple[list[str], list[str]]:
    """Kept and dropped features, both in input order."""
    kept = {r["feature"] for r in feature_variances(df, features, min_variance).filter("kept").collect()}
    return [f for f in features if f in kept], [f for f in features if f not in kept]


def compositional(features: Sequence[str], prefixes: Sequence[str] = ("mgx_", "mtx_")) -> list[str]:
    """Features the log-ratio transform applies to, in table order."""
    return [f for f in features if f.startswith(tuple(prefixes))]


def centred_log_ratio(df: DataFrame, features: Sequence[str], pseudocount: float = 1e-6) -> DataFrame:
    """``log(x + pseudocount)`` minus the row mean of those logs, over ``features`` jointly."""
    if not features:
        return df
    logs = {f: F.ln(quoted(f).cast("double") + F.lit(pseudocount)) for f in features}
    mean = sum((quoted(f) for f in features), F.lit(0.0)) / F.lit(float(len(features)))
    return (
        df.withColumns(logs)
        .withColumn("__mean", mean)
        .withColumns({f: quoted(f) - F.col("__mean") for f in features})
        .drop("__mean")
    )


def standardize(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Zero mean, unit population deviation; a constant feature becomes zero."""
    fit = df.agg(
        F.array(*[F.avg(quoted(f)) for f in features]).alias("m"),
        F.array(*[F.stddev_pop(quoted(f)) for f in features]).alias("s"),
    )
    with_fit = df.withColumn("__fit", fit.select(F.struct("m", "s")).scalar())
    scale = [F.coalesce(F.nullif(F.col("__fit.s")[i], F.lit(0.0)), F.lit(1.0)) for i in range(len(features))]
    return with_fit.withColumns(
        {f: (quoted(f) - F.col("__fit.m")[i]) / scale[i] for i, f in enumerate(features)}
    ).drop("__fit")


def vector_moments(df: DataFrame, vector: str) -> dict:
    """Count, means and population deviations of a vector column, as plain lists."""
    summary = Summarizer.metrics("count", "mean", "variance").summary(array_to_vector(F.col(vector).cast("array<double>")))
    row = df.select(summary.alias("s")).first()["s"]
    n = row["count"]
    shrink = (n - 1) / n if n else 0.0
    return {
        "n": n,
        "means": row["mean"].toArray().tolist(),
        "stds": [(v * shrink) ** 0.5 for v in row["variance"].toArray().tolist()],
    }


def robust_angle_scale(
    df: DataFrame, features: Sequence[str], target: float, percentile: float = 0.9, per_feature: bool = True
) -> DataFrame:
    """``(feature, p90, multiplier)``: ``target / p90`` of the magnitudes; tiny p90 counts as one.

    The global variant has a single row named ``*``, whose tiny p90 gives a multiplier of one.
    """
    magnitudes = to_long(df, features).withColumn("value", F.abs("value"))
    if not per_feature:
        magnitudes = magnitudes.withColumn("feature", F.lit("*"))
    spread = exact_quantiles(magnitudes, "value", [percentile], ["feature"], few_groups=True).select(
        "feature", F.col("quantiles")[0].alias("p90")
    )
    usable = F.col("p90") >= 1e-12
    fallback = F.lit(float(target)) if per_feature else F.lit(1.0)
    return spread.withColumn(
        "multiplier", F.when(usable, F.lit(float(target)) / F.col("p90")).otherwise(fallback)
    )


# --- selection by information ---------------------------------------------------------------


def mutual_information(df: DataFrame, label: str, features: Sequence[str], bins: int = 10) -> DataFrame:
    """``(feature, mutual_information, rank)`` of wide feature columns; see ``mutual_information_long``."""
    return mutual_information_long(to_long(df, features, [label]), label, bins)


def mutual_information_long(long: DataFrame, label: str, bins: int = 10) -> DataFrame:
    """Mutual information (natural log) of quantile-binned features with the label.

    Input rows are ``(label, feature, value)``. Bin edges are exact quantiles, equal values always
    share a bin, and everything after the binning is counts per (feature, bin, class).
    """
    probs = [i / bins for i in range(1, bins)]
    narrow = long.select(label, "feature", "value").filter("value is not null").persist(StorageLevel.DISK_ONLY)
    edges = sized(exact_quantiles(narrow, "value", probs, ["feature"], few_groups=True).select("feature", "quantiles"))
    binned = narrow.join(edges, "feature").withColumn(
        "bin", sum(((F.col("value") > F.col("quantiles")[i]).cast("int") for i in range(bins - 1)), F.lit(0))
    )
    counts = binned.groupBy("feature", "bin", label).agg(F.count(F.lit(1)).cast("double").alias("c"))
    # One row per feature, bin and class is left: the narrow rows are released.
    cells = checkpoint(counts)
    edges.unpersist()
    narrow.unpersist()
    whole, by_bin, by_label = (Window.partitionBy("feature", *extra) for extra in ([], ["bin"], [label]))
    shares = cells.select(
        "feature",
        F.col("c"),
        F.sum("c").over(whole).alias("n"),
        F.sum("c").over(by_bin).alias("in_bin"),
        F.sum("c").over(by_label).alias("in_label"),
    )
    term = F.col("c") / F.col("n") * F.ln(F.col("c") * F.col("n") / (F.col("in_bin") * F.col("in_label")))
    scores = shares.groupBy("feature").agg(F.round(F.sum(term), 12).alias("mutual_information"))
    # One row per feature from here on.
    order = Window.orderBy(F.desc("mutual_information"), "feature")
    return scores.withColumn("rank", F.row_number().over(order))


def select_informative(
    long: DataFrame, label: str, features: Sequence[str], k: int | None, estimator: str = "binned"
) -> list[str]:
    """The ``k`` most informative features in table order; all when ``k`` is unset or not smaller.

    ``estimator`` is ``binned`` or ``neighbours``.
    """
    estimators = {"binned": mutual_information_long, "neighbours": neighbour_information}
    if estimator not in estimators:
        raise ValueError(f"no estimator is called '{estimator}'; there are {', '.join(estimators)}")
    if not k or not 0 < k < len(features):
        return list(features)
    top = {r["feature"] for r in estimators[estimator](long, label).filter(F.col("rank") <= k).collect()}
    return [f for f in features if f in top]


# --- checks ---------------------------------------------------------------------------------


def layout_check(df: DataFrame, names: str, vector: str) -> DataFrame:
    """One row: number of distinct feature orders, narrowest and widest vector, and the verdict."""
    return df.agg(
        F.count_distinct(F.col(names)).alias("orders"),
        F.min(F.size(vector)).alias("min_width"),
        F.max(F.size(vector)).alias("max_width"),
    ).withColumn("consistent", (F.col("orders") == 1) & (F.col("min_width") == F.col("max_width")))


def mean_pool(df: DataFrame, key: str, vector: str, keep: Column, out: str = "embedding") -> DataFrame:
    """Average the kept token vectors of each key.

    The vector mean is a mergeable aggregate with a fixed-size buffer: tokens are averaged before
    the shuffle, so a key with very many tokens is no hot spot and vectors are never exploded.
    """
    mean = Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>")))
    return df.filter(keep).groupBy(key).agg(vector_to_array(mean).alias(out))
