"""Classification metrics from prediction tables.

Everything derives from one ``(true, predicted) -> count`` aggregate, which is tiny compared with
the predictions; optional ``by`` columns (such as the fold) keep separate results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlake.operators.curves import ranking_quality


def pair_counts(df: DataFrame, true: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, F.col(true).alias("true_label"), F.col(predicted).alias("pred_label")).agg(
        F.count(F.lit(1)).alias("count")
    )


def confusion_matrix(df: DataFrame, true: str, predicted: str, labels: Sequence | None = None) -> DataFrame:
    """``(true_label, pred_label, count)`` over the union of both label sets, zero filled.

    With ``labels`` the cells are exactly those of these labels, whatever occurs.

    The label union comes from the count table as one array; a row per cell is generated with a
    zero and merged with the observed counts by a second small aggregate.
    """
    counts = pair_counts(df, true, predicted)
    observed = counts.select(F.explode(F.array("true_label", "pred_label")).alias("label")).distinct()
    if labels is not None:
        kind = dict(counts.dtypes)["true_label"]
        observed = df.sparkSession.createDataFrame([(v,) for v in labels], f"label {kind}")
        counts = counts.filter(F.col("true_label").isin(list(labels)) & F.col("pred_label").isin(list(labels)))
    every = observed.agg(F.collect_set("label")).scalar()
    grid = observed.select(
        F.col("label").alias("true_label"), F.explode(every).alias("pred_label"), F.lit(0).cast("long").alias("count")
    )
    return grid.unionByName(counts).groupBy("true_label", "pred_label").agg(F.sum("count").alias("count"))


def confusion_wide(matrix: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Matrix layout: one row per true label, one column per predicted label."""
    return matrix.groupBy("true_label").pivot("pred_label", list(labels)).agg(F.sum("count")).orderBy("true_label")


def _ratio(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(numerator / F.nullif(denominator, F.lit(0).cast("long")), F.lit(0.0))


def class_scores(df: DataFrame, true: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """Per class: precision, recall, f1 (zero when undefined), support and predicted count."""
    zero = F.lit(0).cast("long")
    hit = F.when(F.col("true_label") == F.col("pred_label"), F.col("count")).otherwise(zero)
    sides = F.array(
        F.struct(F.col("true_label").alias("label"), F.col("count").alias("s"), zero.alias("p"), hit.alias("t")),
        F.struct(F.col("pred_label").alias("label"), zero.alias("s"), F.col("count").alias("p"), zero.alias("t")),
    )
    sums = (
        pair_counts(df, true, predicted, by)
        .select(*by, F.explode(sides).alias("side"))
        .groupBy(*by, "side.label")
        .agg(
            F.sum("side.t").alias("hits"),
            F.sum("side.s").alias("support"),
            F.sum("side.p").alias("predicted"),
        )
    )
    return sums.select(
        *by,
        "label",
        _ratio(F.col("hits"), F.col("predicted")).alias("precision"),
        _ratio(F.col("hits"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("hits"), F.col("support") + F.col("predicted")).alias("f1"),
        "support",
        "predicted",
        "hits",
    )


def summary_scores(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, balanced accuracy, macro and support-weighted averages from ``class_scores``."""
    total = F.sum("support")

    def weighted(name: str) -> Column:
        return F.sum(F.col(name) * F.col("support")) / F.nullif(total, F.lit(0).cast("long"))

    return scores.groupBy(*by).agg(
        (F.sum("hits") / F.nullif(total, F.lit(0).cast("long"))).alias("accuracy"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        F.avg("precision").alias("precision_macro"),
        F.avg("recall").alias("recall_macro"),
        F.avg("f1").alias("f1_macro"),
        weighted("precision").alias("precision_weighted"),
        weighted("recall").alias("recall_weighted"),
        weighted("f1").alias("f1_weighted"),
        F.coalesce(total, F.lit(0).cast("long")).alias("n"),
    )


def accuracy(df: DataFrame, true: str, predicted: str) -> DataFrame:
    return df.agg(F.avg((F.col(true) == F.col(predicted)).cast("double")).alias("accuracy"))


def classification_report(df: DataFrame, true: str, predicted: str) -> DataFrame:
    """Per-class rows followed by ``accuracy``, ``macro avg`` and ``weighted avg``."""
    scores = class_scores(df, true, predicted)
    total = summary_scores(scores)

    def row(name: str, p: str, r: str, f: str) -> DataFrame:
        return total.select(
            F.lit(name).alias("label"),
            F.col(p).alias("precision"),
            F.col(r).alias("recall"),
            F.col(f).alias("f1"),
            F.col("n").alias("support"),
        )

    return (
        scores.select(F.col("label").cast("string"), "precision", "recall", "f1", "support")
        .unionByName(row("accuracy", "accuracy", "accuracy", "accuracy"))
        .unionByName(row("macro avg", "precision_macro", "recall_macro", "f1_macro"))
        .unionByName(row("weighted avg", "precision_weighted", "recall_weighted", "f1_weighted"))
    )


def one_vs_rest_rows(df: DataFrame, true: str, probabilities: dict[str, str]) -> DataFrame:
    """Binarise: one row per (prediction, class) with its probability; a missing one counts as 0."""
    cells = [
        F.struct(
            F.lit(label).alias("label"),
            F.coalesce(F.col(column).cast("double"), F.lit(0.0)).alias("score"),
            (F.col(true) == F.lit(label)).cast("int").alias("positive"),
        )
        for label, column in probabilities.items()
    ]
    return df.select(F.inline(F.array(*cells)))


def one_vs_rest_quality(df: DataFrame, true: str, probabilities: dict[str, str]) -> DataFrame:
    """ROC area and average precision per class; ``avg`` of a column is the macro value."""
    return ranking_quality(one_vs_rest_rows(df, true, probabilities), "score", "positive", ["label"])


def performance_table(
    df: DataFrame, true: str, predicted: str, probabilities: dict[str, str] | None = None
) -> DataFrame:
    """Tidy ``(metric, value)`` rows; ranking metrics are included when probabilities are given.

    Two classes use the score of the second one; more classes use the one-vs-rest macro mean of
    the ROC area.
    """
    names = [
        "accuracy",
        "precision_macro",
        "recall_macro",
        "f1_macro",
        "precision_weighted",
        "recall_weighted",
        "f1_weighted",
    ]
    table = summary_scores(class_scores(df, true, predicted)).unpivot([], names, "metric", "value")
    if not probabilities:
        return table
    labels = sorted(probabilities)
    if len(labels) == 2:
        positive = {labels[1]: probabilities[labels[1]]}
        ranking = one_vs_rest_quality(df, true, positive).unpivot(
            [], ["roc_auc", "average_precision"], "metric", "value"
        )
    else:
        ranking = one_vs_rest_quality(df, true, probabilities).select(
            F.lit("roc_auc").alias("metric"), F.col("roc_auc").alias("value")
        )
        ranking = ranking.groupBy("metric").agg(F.avg("value").alias("value"))
    return table.unionByName(ranking.filter(F.col("value").isNotNull()))


def top_weights(weights: DataFrame, label: str, feature: str, weight: str, k: int = 10) -> DataFrame:
    """The ``k`` features with the largest weight per class, ranked from 1."""
    order = Window.partitionBy(label).orderBy(F.desc(weight), feature)
    return weights.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
