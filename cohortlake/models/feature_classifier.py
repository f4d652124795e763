"""Logistic regression on feature vectors with stratified group folds."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.models.linear import Bundle, in_parallel, index_of, label_at, weighted_rows
from cohortlake.models.output import LinearModel, index_of_greatest
from cohortlake.models.stacked import Design, GroupMoments, fit_stacked, group_moments, stacked_rows
from cohortlake.operators.features import compositional, select_informative, vector_to_long
from cohortlake.operators.labels import sorted_labels
from cohortlake.operators.projection import Scaling, log_ratio_column
from cohortlake.operators.splits import fold_count, with_group_fold
from cohortlake.session import checkpoint


# Entries a stored classifier must have.
REQUIRED = ("labels", "features", "selected", "scaling", "pseudocount")


@dataclass(frozen=True)
class Settings:
    seed: int = 42
    C: float = 1.0
    balanced: bool = True
    cv_splits: int = 5
    feature_k: int | None = None
    pseudocount: float = 1e-6
    max_iter: int = 1000
    estimator: str = "binned"  # of a feature's information; or neighbours


@dataclass
class FittedClassifier:
    """Scaling, selected features and the logistic model, fitted on the same rows."""

    labels: list
    features: list[str]
    selected: list[str]
    scaling: Scaling
    model: LinearModel

    def bundle(self, s: Settings) -> Bundle:
        settings = {
            "labels": self.labels,
            "features": self.features,
            "selected": self.selected,
            "scaling": vars(self.scaling),
            "pseudocount": s.pseudocount,
        }
        return Bundle(self.model, settings)

    @staticmethod
    def restore(bundle: Bundle) -> FittedClassifier:
        s = bundle.settings
        return FittedClassifier(s["labels"], s["features"], s["selected"], Scaling(**s["scaling"]), bundle.model)

    def coefficients(self, spark) -> DataFrame:
        """``(label, feature, weight)``; with two classes the first one has the negated weights."""
        matrix = self.model.coefficientMatrix.toArray()
        if len(self.labels) == 2:
            matrix = [-matrix[0], matrix[0]]
        rows = [
            (str(label), name, float(w))
            for label, weights in zip(self.labels, matrix)
            for name, w in zip(self.selected, weights)
        ]
        return spark.createDataFrame(rows, "label string, feature string, weight double")


def informative(df: DataFrame, features: Sequence[str], s: Settings) -> list[int]:
    """Positions of the features to fit on: all, or the ``feature_k`` most informative ones of these rows."""
    keep = list(range(len(features)))
    if s.feature_k and 0 < s.feature_k < len(features):
        long = vector_to_long(df, "features", ["label"]).withColumnRenamed("position", "feature")
        keep = select_informative(long, "label", keep, s.feature_k, s.estimator)
    return keep


def fit_folds(df: DataFrame, features: Sequence[str], labels: Sequence, unseen: Sequence[int | None], s: Settings) -> list[FittedClassifier]:
    """One classifier per entry of ``unseen``, fitted without the rows of that fold (None: on all rows).

    ``df`` has ``(label, features, fold)``. Scaling, class weights and feature choice see the rows of
    the fit only. All fits advance together, so their number does not change the number of jobs.
    """
    rows = df.select(*stacked_rows(F.col("fold"), index_of("label", labels), F.col("features")))
    folds = max([f for f in unseen if f is not None], default=0) + 1
    moments: GroupMoments = group_moments(rows, folds, len(labels))
    seen = [df if f is None else df.filter(F.col("fold") != f) for f in unseen]
    kept = in_parallel(lambda part: informative(part, features, s), seen)
    designs: list[Design] = [moments.design(f, s.balanced, s.C, keep) for f, keep in zip(unseen, kept, strict=True)]
    models = fit_stacked(rows, designs, len(labels), s.max_iter)
    out = []
    for design, keep, model in zip(designs, kept, models, strict=True):
        own = LinearModel(np.array(model.weights)[:, keep].tolist(), model.intercepts, model.link)
        # Features of no spread keep the factor 1, as ``Scaling`` reads a zero deviation.
        stds = np.where(design.inverse == 0, 0.0, 1.0 / np.where(design.inverse == 0, 1.0, design.inverse))
        scaling = Scaling(design.means.tolist(), stds.tolist(), list(keep))
        out.append(FittedClassifier(list(labels), list(features), [features[i] for i in keep], scaling, own))
    return out


def fit(df: DataFrame, features: Sequence[str], labels: Sequence, s: Settings) -> FittedClassifier:
    """Fit on ``(label, features)`` rows: scale, optionally select by information, regress."""
    return fit_folds(df.withColumn("fold", F.lit(0)), features, labels, [None], s)[0]


def objective_gradient(fitted: FittedClassifier, df: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``(label, feature, gradient)`` of the penalised mean loss at the fitted coefficients.

    All entries are near zero at the optimum; the rows must be those of the fit. The intercepts,
    which carry no penalty, are listed under the feature name ``intercept``.
    """
    rows = weighted_rows(df, "label", fitted.labels, fitted.scaling.column(F.col("features")), s.balanced)
    scored = rows.select("__w", "__y", vector_to_array("__x").alias("x")).select(
        "__w", "__y", F.concat("x", F.array(F.lit(1.0))).alias("x"), fitted.model.outputs(F.col("x")).alias("p")
    )
    residuals = scored.select("__w", "x", F.posexplode(F.transform("p", lambda p, c: p - (c == F.col("__y")).cast("double"))).alias("c", "r"))
    cells = residuals.select("__w", "c", "r", F.posexplode("x").alias("j", "v"))
    total = rows.agg(F.sum("__w")).scalar()
    mean = cells.groupBy("c", "j").agg((F.sum(F.col("__w") * F.col("r") * F.col("v")) / total).alias("g"))
    names = [*fitted.selected, "intercept"]
    strength = 1.0 / (s.C * rows.agg(F.sum("__w")).first()[0])
    matrix = fitted.model.coefficientMatrix.toArray()
    if len(fitted.labels) == 2:  # one vector of coefficients, for the second class
        mean = mean.filter("c = 1")
        matrix = [[0.0] * matrix.shape[1], matrix[0]]
    weights = [
        (c, j, str(label), name, strength * float(matrix[c][j]) if j < len(fitted.selected) else 0.0)
        for c, label in enumerate(fitted.labels)
        for j, name in enumerate(names)
    ]
    known = df.sparkSession.createDataFrame(weights, "c int, j int, label string, feature string, pull double")
    return mean.join(known, ["c", "j"]).select("label", "feature", (F.col("g") + F.col("pull")).alias("gradient"))


def score(fitted: FittedClassifier, df: DataFrame) -> DataFrame:
    """Add ``prediction_index``, ``prediction`` and one ``proba_<label>`` column per class.

    A class the model never saw has probability 0.
    """
    point = fitted.scaling.column(F.col("features"))
    rows = df.select("sample_id", "fold", "label", index_of("label", fitted.labels).alias("__y"), fitted.model.outputs(point).alias("__pr"))
    scored = rows.withColumn("prediction", index_of_greatest(F.col("__pr")))
    chances = [
        F.coalesce(F.get(F.col("__pr"), F.lit(i)), F.lit(0.0)).alias(f"proba_{label}")
        for i, label in enumerate(fitted.labels)
    ]
    return scored.select(
        "sample_id",
        "fold",
        F.col("__y").cast("int").alias("label_index"),
        "label",
        F.col("prediction").cast("int").alias("prediction_index"),
        label_at(F.col("prediction"), fitted.labels).alias("prediction"),
        *chances,
    )


def score_by_fold(fitted: Sequence[FittedClassifier], df: DataFrame) -> DataFrame:
    """``score`` of every row by the classifier of its own fold; one pass for all folds."""
    labels = fitted[0].labels
    chances = [m.model.outputs(m.scaling.column(F.col("features"))) for m in fitted]
    own = F.coalesce(*[F.when(F.col("fold") == i, c) for i, c in enumerate(chances)])
    rows = df.select("sample_id", "fold", "label", "features", index_of("label", labels).cast("int").alias("label_index"))
    scored = rows.withColumn("__pr", own).withColumn("prediction_index", index_of_greatest(F.col("__pr")))
    return scored.select(
        "sample_id",
        "fold",
        "label_index",
        "label",
        "prediction_index",
        label_at(F.col("prediction_index"), labels).alias("prediction"),
        *[F.coalesce(F.get("__pr", F.lit(i)), F.lit(0.0)).alias(f"proba_{label}") for i, label in enumerate(labels)],
    )


def prepared(df: DataFrame, features: Sequence[str], s: Settings) -> DataFrame:
    """Log-ratio transform the compositional positions of the feature vector."""
    chosen = set(compositional(features))
    positions = [i for i, name in enumerate(features) if name in chosen]
    return df.withColumn("features", log_ratio_column(F.col("features"), positions, s.pseudocount))


def cross_fit(df: DataFrame, features: Sequence[str], s: Settings = Settings()) -> tuple[DataFrame, list[FittedClassifier]]:
    """The prepared rows with their fold, and one classifier per fold that never saw the fold.

    ``df`` has ``(sample_id, label, group_id, features)``. Scaling, selection and weights of a fold come
    from the other folds only. The rows are stored once; all folds are fitted in the same jobs.
    """
    rows = prepared(df, features, s)
    labels = sorted_labels(rows, "label")
    if len(labels) < 2:
        raise ValueError("training needs rows with two labels or more")
    folds = int(fold_count(rows, "label", "group_id", s.cv_splits).first()["folds"])
    rows = checkpoint(with_group_fold(rows, "label", "group_id", folds, s.seed).select("sample_id", "label", "features", "fold"))
    return rows, fit_folds(rows, features, labels, list(range(folds)), s)


def cross_validate(df: DataFrame, features: Sequence[str], s: Settings = Settings()) -> tuple[DataFrame, int]:
    """Out-of-fold predictions of ``(sample_id, label, group_id, features)`` rows, and the fold count."""
    rows, fitted = cross_fit(df, features, s)
    return score_by_fold(fitted, rows), len(fitted)


def fit_all(df: DataFrame, features: Sequence[str], s: Settings = Settings()) -> FittedClassifier:
    rows = checkpoint(prepared(df, features, s).select("label", "features"))
    labels = sorted_labels(rows, "label")
    if len(labels) < 2:
        raise ValueError("training needs rows with two labels or more")
    return fit(rows, features, labels, s)
