"""Kernel SVMs as linear SVMs on explicit kernel features of landmark rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.models.dual import Machine, fit_machines
from cohortlake.models.linear import Bundle, label_at, predict, weighted_rows
from cohortlake.models.output import LinearModel, index_of_greatest
from cohortlake.operators.kernels import (
    MOST_REFERENCES,
    Kernel,
    KernelFeatures,
    angles,
    cosine,
    fidelity,
    kernel_features_column,
    linear,
    rbf,
    reference_set,
    scale_gamma,
)
from cohortlake.operators.features import vector_moments
from cohortlake.operators.labels import sorted_labels
from cohortlake.operators.metrics import class_scores, summary_scores
from cohortlake.operators.projection import Components, fit_components
from cohortlake.operators.ranking import sample_per_class
from cohortlake.operators.splits import stratified_split
from cohortlake.session import checkpoint

# Entries a stored kernel model must have.
REQUIRED = ("components", "kernel", "gamma", "centred", "overall", "landmarks")


@dataclass(frozen=True)
class Candidate:
    """A kernel to try; ``gamma_factor`` multiplies the scale that the training rows suggest."""

    kernel: str = "rbf"
    gamma_factor: float = 1.0
    centred: bool = True

    def function(self, gamma: float) -> Kernel:
        return kernel_named(self.kernel, gamma * self.gamma_factor)


def kernel_named(name: str, gamma: float) -> Kernel:
    """``gamma`` is used by the radial kernel, its square root by the angle kernel."""
    makers = {
        "linear": lambda: linear,
        "cosine": lambda: cosine,
        "fidelity": lambda: fidelity,
        "rbf": lambda: rbf(gamma),
        "angles": lambda: angles(gamma**0.5),
    }
    if name not in makers:
        raise ValueError(f"no kernel is called '{name}'; there are {', '.join(makers)}")
    return makers[name]()


@dataclass(frozen=True)
class Settings:
    """``per_class_limit`` bounds the training rows of a class; every test row is scored."""

    pca_components: int = 12
    kernels: Sequence[str] = ("rbf",)
    gamma_factors: Sequence[float] = (1.0,)
    centrings: Sequence[bool] = (True,)
    per_class_limit: int | None = 200
    landmarks_per_class: int = 200
    C: float = 1.0
    balanced: bool = True
    test_size: float = 0.25
    seed: int = 42
    max_iter: int = 100

    def candidates(self) -> list[Candidate]:
        """Kernels without a scale appear once for each centring."""
        scaled = {k: self.gamma_factors if k in ("rbf", "angles") else (1.0,) for k in self.kernels}
        return [Candidate(k, g, c) for k in self.kernels for g in scaled[k] for c in self.centrings]


@dataclass
class FittedKernel:
    labels: list
    features: KernelFeatures
    kernel: Kernel
    model: object
    landmark_count: int

    def predict(self, df: DataFrame, vector: str) -> DataFrame:
        column = kernel_features_column(df, F.col(vector), self.features, self.kernel)
        return predict(self.model, df, column, self.labels)


def fit_kernel_svms(
    df: DataFrame, ident: str, label: str, vector: str, choices: Sequence[tuple[Kernel, bool]], labels: Sequence, s: Settings
) -> list[FittedKernel]:
    """One machine set per (kernel, centred) choice, all fitted in the same jobs on one landmark sample.

    The kernel features of all choices lie side by side in each row, filled up with zeros to the
    widest; the landmarks are all rows when the classes are small.
    """
    chosen = sample_per_class(df, label, ident, s.landmarks_per_class, s.seed)
    refs = reference_set(chosen, ident, vector, max(MOST_REFERENCES, s.landmarks_per_class * len(labels)))
    features = [KernelFeatures.fit(refs.matrix, kernel, centred) for kernel, centred in choices]
    width = max(f.basis.shape[1] for f in features)
    columns = []
    for (kernel, _), f in zip(choices, features, strict=True):
        own = kernel_features_column(df, F.col(vector), f, kernel)
        columns.append(F.concat(own, F.array_repeat(F.lit(0.0), width - f.basis.shape[1])))
    rows = weighted_rows(df, label, labels, F.concat(*columns), s.balanced)
    targets = [1] if len(labels) == 2 else list(range(len(labels)))
    machines = [Machine(k, i, s.C) for i in range(len(choices)) for k in targets]
    found = fit_machines(rows, machines, width, len(choices), max_steps=s.max_iter)
    out = []
    for i, ((kernel, _), f) in enumerate(zip(choices, features, strict=True)):
        model = found.model(range(i * len(targets), (i + 1) * len(targets)))
        cut = LinearModel([w[: f.basis.shape[1]] for w in model.weights], model.intercepts, model.link)
        out.append(FittedKernel(list(labels), f, kernel, cut, len(refs.ids)))
    return out


def fit_kernel_svm(
    df: DataFrame, ident: str, label: str, vector: str, kernel: Kernel, labels: Sequence, s: Settings, centred: bool
) -> FittedKernel:
    """Fit on all rows of ``df`` with landmarks drawn from it (all rows when the classes are small)."""
    return fit_kernel_svms(df, ident, label, vector, [(kernel, centred)], labels, s)[0]


def judged(fitted: Sequence[FittedKernel], df: DataFrame, label: str, vector: str) -> list[float]:
    """Macro F1 of every model on the same rows, scored in one pass."""
    outputs = [
        m.model.outputs(kernel_features_column(df, F.col(vector), m.features, m.kernel)).alias(f"o{i}") for i, m in enumerate(fitted)
    ]
    wide = df.select(F.col(label).alias("label"), *outputs)
    cases = [
        F.struct(F.lit(i).alias("model"), label_at(index_of_greatest(F.col(f"o{i}")), m.labels).alias("prediction")) for i, m in enumerate(fitted)
    ]
    rows = wide.select("label", F.inline(F.array(*cases)))
    scores = summary_scores(class_scores(rows, "label", "prediction", ["model"]), ["model"])
    found = {r["model"]: r["f1_macro"] for r in scores.collect()}
    return [found[i] for i in range(len(fitted))]


def evaluate(fitted: FittedKernel, df: DataFrame, label: str, vector: str) -> dict:
    predicted = fitted.predict(df, vector)
    return summary_scores(class_scores(predicted, label, "prediction")).first().asDict()


def _compare(name: str, scores: dict) -> dict:
    keep = ("accuracy", "precision_macro", "recall_macro", "f1_macro", "balanced_accuracy")
    return {f"{name}_{k}": scores[k] for k in keep}


@dataclass
class Final:
    """A model of all rows, with its projection and the kernel it was fitted with."""

    components: Components
    best: Candidate
    gamma: float
    fitted: FittedKernel

    def bundle(self, spark: SparkSession) -> Bundle:
        """Everything scoring needs; landmark rows with their basis are stored as a table."""
        features = self.fitted.features
        rows = [
            (i, v.tolist(), float(m), b.tolist())
            for i, (v, m, b) in enumerate(zip(features.landmarks, features.column_means, features.basis, strict=True))
        ]
        table = spark.createDataFrame(
            rows, "position int, landmark array<double>, column_mean double, basis array<double>"
        )
        settings = {
            "components": vars(self.components),
            "kernel": self.best.kernel,
            "gamma": self.gamma * self.best.gamma_factor,
            "centred": self.best.centred,
            "overall": features.overall,
            "labels": self.fitted.labels,
            "landmark_count": self.fitted.landmark_count,
        }
        return Bundle(self.fitted.model, settings, {"landmarks": table})


@dataclass
class Comparison:
    metrics: dict
    predictions: DataFrame
    final: Final

    def bundle(self, spark: SparkSession) -> Bundle:
        return self.final.bundle(spark)


def metric_rows(spark: SparkSession, metrics: dict) -> DataFrame:
    """All metrics as ``(metric, value)`` text rows: numbers to six places, lists entry by entry."""

    def flat(name: str, value) -> list[tuple[str, str]]:
        if isinstance(value, dict):
            return [row for k, v in value.items() for row in flat(f"{name}.{k}", v)]
        if isinstance(value, (list, tuple)):
            return [row for i, v in enumerate(value) for row in flat(f"{name}[{i}]", v)]
        return [(name, f"{value:.6f}" if isinstance(value, float) else str(value))]

    return spark.createDataFrame([row for k, v in metrics.items() for row in flat(k, v)], "metric string, value string")


def _choose(
    training: DataFrame, ident: str, label: str, labels: list, gamma: float, s: Settings
) -> tuple[Candidate, list[float | None], list[str]]:
    """Best candidate by macro F1 on a validation part of the training rows; the first one wins ties.

    The landmark sample, the split and the scale are the same for all candidates. Only an unknown
    kernel counts as a failed candidate; other errors are raised.
    """
    candidates = s.candidates()
    usable, failures = [], []
    for candidate in candidates:
        try:
            candidate.function(gamma)
            usable.append(candidate)
        except ValueError as error:
            failures.append(f"{candidate}: {error}")
    if not usable:
        raise ValueError(f"none of the kernels can be used: {failures}")
    if len(usable) == 1:
        return usable[0], [None], failures
    inner = checkpoint(stratified_split(training, label, ident, 0.25, s.seed + 1))
    fit_part, judge_part = (inner.filter(F.col("part") == p) for p in ("train", "test"))

    fitted = fit_kernel_svms(fit_part, ident, label, "x", [(c.function(gamma), c.centred) for c in usable], labels, s)
    results = judged(fitted, judge_part, label, "x")
    ranked = [(-r, i) for i, r in enumerate(results)]
    return usable[min(ranked)[1]], results, failures


def split_rows(df: DataFrame, ident: str, label: str, vector: str, s: Settings) -> DataFrame:
    """All rows with their part; the training part is then bounded per class, the test part never."""
    rows = stratified_split(df.select(ident, label, vector), label, ident, s.test_size, s.seed)
    training = sample_per_class(rows.filter("part = 'train'"), label, ident, s.per_class_limit, s.seed)
    return checkpoint(training.unionByName(rows.filter("part = 'test'")))


def train(df: DataFrame, ident: str, label: str, vector: str, s: Settings = Settings()) -> Comparison:
    """Compare an RBF baseline with the best of several kernels on a held-out test part.

    All rows are split; only the training rows are bounded per class, and every test row is scored.
    Candidates are compared on a validation part cut from the training rows, so the test part plays
    no role in the choice; the winner and the baseline are fitted on the training rows. The final
    model is fitted on all rows, bounded per class likewise.
    """
    rows = split_rows(df, ident, label, vector, s)
    labels = sorted_labels(rows, label)
    if len(labels) < 2:
        raise ValueError("kernel training needs rows of two classes or more")
    components = fit_components(rows.filter("part = 'train'"), vector, s.pca_components)
    reduced = checkpoint(rows.select(ident, label, "part", components.column(F.col(vector)).alias("x")))
    training = reduced.filter("part = 'train'").drop("part")
    test = reduced.filter("part = 'test'").drop("part")

    gamma = scale_gamma(vector_moments(training, "x"))
    winner, validated, failures = _choose(training, ident, label, labels, gamma, s)
    both = [(rbf(gamma), False), (winner.function(gamma), winner.centred)]
    baseline, chosen = fit_kernel_svms(training, ident, label, "x", both, labels, s)
    baseline_scores = evaluate(baseline, test, label, "x")
    predictions = chosen.predict(test, "x").select(F.col(ident).alias("sample_id"), label, "prediction")
    kernel_scores = evaluate(chosen, test, label, "x")
    sizes = {r["part"]: r["count"] for r in rows.groupBy("part").count().collect()}
    metrics = {
        "used_features": len(components.axes),
        "classes": labels,
        "n_train": sizes.get("train", 0),
        "n_test": sizes.get("test", 0),
        **_compare("kernel", kernel_scores),
        **_compare("baseline", baseline_scores),
        "accuracy_delta": kernel_scores["accuracy"] - baseline_scores["accuracy"],
        "best_params": vars(winner),
        "candidates_tested": len(s.candidates()),
        "validation_f1_macro": [r for r in validated if r is not None],
        "candidates_failed": failures,
        "landmark_count": chosen.landmark_count,
    }
    return Comparison(metrics, predictions, fit_final(df, ident, label, vector, s, winner))


def fit_final(
    df: DataFrame, ident: str, label: str, vector: str, s: Settings = Settings(), winner: Candidate | None = None
) -> Final:
    """The model to store: the given candidate, or the only one, on all rows bounded per class."""
    winner = winner or s.candidates()[0]
    rows = checkpoint(sample_per_class(df.select(ident, label, vector), label, ident, s.per_class_limit, s.seed))
    labels = sorted_labels(rows, label)
    components = fit_components(rows, vector, s.pca_components)
    reduced = checkpoint(rows.select(ident, label, components.column(F.col(vector)).alias("x")))
    gamma = scale_gamma(vector_moments(reduced, "x"))
    fitted = fit_kernel_svm(reduced, ident, label, "x", winner.function(gamma), labels, s, winner.centred)
    return Final(components, winner, gamma, fitted)


def rbf_baseline(df: DataFrame, ident: str, label: str, vector: str, s: Settings = Settings()) -> DataFrame:
    """Predictions of the RBF model alone, for every test row."""
    rows = split_rows(df, ident, label, vector, s)
    labels = sorted_labels(rows, label)
    components = fit_components(rows.filter("part = 'train'"), vector, s.pca_components)
    reduced = checkpoint(rows.select(ident, label, "part", components.column(F.col(vector)).alias("x")))
    training = reduced.filter("part = 'train'")
    kernel = rbf(scale_gamma(vector_moments(training, "x")))
    fitted = fit_kernel_svm(training, ident, label, "x", kernel, labels, s, centred=False)
    return fitted.predict(reduced.filter("part = 'test'"), "x").select(ident, label, "prediction")


def restore(bundle: Bundle) -> tuple[Components, FittedKernel]:
    """Rebuild the projection and the kernel model from a stored bundle."""
    s = bundle.settings
    table = bundle.tables["landmarks"].orderBy("position").collect()
    features = KernelFeatures(
        np.array([r["landmark"] for r in table]),
        np.array([r["column_mean"] for r in table]),
        s["overall"],
        np.array([r["basis"] for r in table]),
        s["centred"],
    )
    fitted = FittedKernel(s["labels"], features, kernel_named(s["kernel"], s["gamma"]), bundle.model, len(table))
    return Components(**s["components"]), fitted
