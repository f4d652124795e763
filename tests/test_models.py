import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlake.models import feature_classifier as fc
from cohortlake.models import kernel_svm
from cohortlake.models.linear import Bundle, fit_svm, predict, weighted_rows
from cohortlake.plans import jobs

NAMES = ["mgx_a", "mgx_b", "age", "noise"]


def cohort(spark, classes=2, n=240, seed=0):
    """Samples in groups of two; ``mgx_a`` and ``age`` carry the class."""
    rng = np.random.default_rng(seed)
    y = np.arange(n) % classes
    x = np.column_stack([np.exp(y + rng.normal(size=n)), np.exp(rng.normal(size=n)), 3.0 * y + rng.normal(size=n), rng.normal(size=n)])
    rows = [(f"s{i}", f"c{k}", f"g{i // (2 * classes)}", r.tolist()) for i, (k, r) in enumerate(zip(y, x))]
    return x, y, spark.createDataFrame(rows, "sample_id string, label string, group_id string, features array<double>").repartition(4)


@pytest.mark.parametrize("classes", [2, 3])
def test_cross_validation(spark, tmp_path, classes):
    x, y, df = cohort(spark, classes)
    result = jobs.train_feature_classifier(df, NAMES, fc.Settings(max_iter=50, cv_splits=3, feature_k=3))
    predictions = result["predictions"]
    assert predictions.count() == len(y) and predictions.select("sample_id").distinct().count() == len(y)
    folds = predictions.join(df.select("sample_id", "group_id"), "sample_id").groupBy("group_id").agg(F.count_distinct("fold").alias("n"))
    assert folds.agg(F.max("n")).first()[0] == 1 and result["cv_splits"] == 3
    probabilities = [f"proba_c{k}" for k in range(classes)]
    off = predictions.select(F.max(F.abs(sum(F.col(c) for c in probabilities) - 1)).alias("d")).first()["d"]
    assert off < 1e-9
    scores = result["performance"].first()
    assert scores["f1_macro"] > 0.8 and result["ranking"].first()["roc_auc_ovr"] > 0.9
    assert result["confusion_matrix"].agg(F.sum("count")).first()[0] == len(y)
    assert result["fold_metrics"].count() == 3
    top = {(r["label"], r["rank"]): r["feature"] for r in result["top_features"].collect()}
    path = str(tmp_path / "classifier")
    result["fitted"].bundle(fc.Settings()).save(spark, path)
    restored = fc.FittedClassifier.restore(Bundle.load(spark, path, fc.REQUIRED))
    rows = fc.prepared(df.withColumn("fold", F.lit(0)), NAMES, fc.Settings())
    pair = [{r["sample_id"]: r["prediction"] for r in fc.score(m, rows).collect()} for m in (restored, result["fitted"])]
    assert pair[0] == pair[1] and len(pair[0]) == len(y)
    assert top[f"c{classes - 1}", 1] == "age" and "noise" not in result["fitted"].selected


def test_logistic_fit_matches_its_objective(spark):
    """At the fitted weights the gradient of the penalised, weighted loss vanishes."""
    x, y, df = cohort(spark, 2, 200, 3)
    s = fc.Settings(C=0.7, max_iter=500)
    fitted = fc.fit(df, NAMES, ["c0", "c1"], s)
    z = (x - x.mean(0)) / x.std(0)
    w, b = fitted.model.coefficients.toArray(), fitted.model.intercept
    p = 1 / (1 + np.exp(-(z @ w + b)))
    weight = np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y == 0).sum()))
    gradient = w / s.C + (weight * (p - y)) @ z
    assert np.abs(gradient).max() < 1e-2 * np.abs((weight * (0.5 - y)) @ z).max()
    weights = {(r["label"], r["feature"]): r["weight"] for r in fitted.coefficients(spark).collect()}
    assert weights["c1", "age"] > 0 and weights["c0", "age"] == -weights["c1", "age"]


def test_single_class_is_rejected(spark):
    _, _, df = cohort(spark, 1, 10)
    with pytest.raises(ValueError, match="two labels or more"):
        fc.cross_validate(df, NAMES)


def test_linear_svm_is_near_the_optimum(spark):
    rng = np.random.default_rng(2)
    y = np.arange(200) % 2
    x = rng.normal(size=(200, 2)) + 1.2 * (2 * y[:, None] - 1)
    df = spark.createDataFrame([(int(k), r.tolist()) for k, r in zip(y, x)], "label int, v array<double>")
    model = fit_svm(weighted_rows(df, "label", [0, 1], F.col("v"), False), 2, 2, 1.0, 200)

    def objective(w, b):
        return 0.5 * w @ w + np.maximum(0, 1 - (2 * y - 1) * (x @ w + b)).sum()

    w, b = model.coefficients.toArray(), model.intercept
    best, step = (np.zeros(2), 0.0), None
    for t in range(1, 8000):
        active = (2 * y - 1) * (x @ best[0] + best[1]) < 1
        gw = best[0] - ((2 * y - 1) * active) @ x
        gb = -((2 * y - 1) * active).sum()
        step = 0.5 / t**0.75 / 20
        best = (best[0] - step * gw, best[1] - step * gb)
    assert objective(w, b) <= objective(*best) * 1.01


@pytest.mark.parametrize("classes", [2, 3])
def test_bundle_round_trip(spark, tmp_path, classes):
    x, y, df = cohort(spark, classes, 90)
    labels = [f"c{k}" for k in range(classes)]
    model = fit_svm(weighted_rows(df, "label", labels, F.col("features"), True), classes, 4, max_iter=30)
    path = str(tmp_path / "model")
    Bundle(model, {"labels": labels}).save(spark, path)
    loaded = Bundle.load(spark, path, ["labels"])
    before = {r["sample_id"]: r["prediction"] for r in predict(model, df, F.col("features"), labels).collect()}
    after = {r["sample_id"]: r["prediction"] for r in predict(loaded.model, df, F.col("features"), labels).collect()}
    assert before == after and set(after.values()) <= set(labels)
    with pytest.raises(ValueError, match="lacks"):
        Bundle.load(spark, path, ["components"])


def rings(spark, n=120):
    """Two classes no line separates: distance from the origin."""
    rng = np.random.default_rng(11)
    y = np.arange(n) % 2
    angle = rng.uniform(0, 2 * np.pi, n)
    radius = np.where(y == 1, 2.0, 0.5) + rng.normal(scale=0.1, size=n)
    x = np.column_stack([radius * np.cos(angle), radius * np.sin(angle)])
    rows = [(f"r{i}", "in" if k == 0 else "out", r.tolist()) for i, (k, r) in enumerate(zip(y, x))]
    return spark.createDataFrame(rows, "seq_id string, label string, embedding array<double>")


def test_kernel_training_and_scoring(spark, tmp_path):
    df = rings(spark)
    settings = kernel_svm.Settings(pca_components=2, kernels=("rbf", "odd"), gamma_factors=(0.5, 1.0), centrings=(True,), per_class_limit=30)
    found = jobs.train_kernel_svm(df.drop("label"), df.select("seq_id", "label"), settings)
    m = found.metrics
    assert (m["n_train"], m["n_test"], m["used_features"], m["candidates_tested"]) == (60, 30, 2, 3)
    assert len(m["candidates_failed"]) == 1 and m["best_params"]["kernel"] == "rbf" and len(m["validation_f1_macro"]) == 2
    for name in ("kernel", "baseline"):
        assert {f"{name}_{k}" for k in ("accuracy", "precision_macro", "recall_macro", "f1_macro")} <= set(m)
    assert m["baseline_f1_macro"] > 0.9 and m["accuracy_delta"] == pytest.approx(m["kernel_accuracy"] - m["baseline_accuracy"])
    assert found.predictions.count() == 30 and found.predictions.columns == ["sample_id", "label", "prediction"]
    path = str(tmp_path / "kernel")
    found.bundle(spark).save(spark, path)
    bundle = Bundle.load(spark, path, kernel_svm.REQUIRED)
    scored = {r["seq_id"]: r["prediction"] for r in jobs.score_kernel_model(df.drop("label"), bundle).collect()}
    point = found.final.components.column(F.col("embedding")).alias("x")
    direct = found.final.fitted.predict(df.select("seq_id", point), "x")
    assert scored == {r["seq_id"]: r["prediction"] for r in direct.collect()} and len(scored) == 120


def test_kernel_training_checks(spark):
    df = rings(spark, 20)
    labels = df.select("seq_id", "label")
    with pytest.raises(ValueError, match="no label for"):
        jobs.train_kernel_svm(df.drop("label"), labels.filter("seq_id <> 'r3'"))
    with pytest.raises(ValueError, match="two classes"):
        jobs.train_kernel_svm(df.drop("label"), labels.withColumn("label", F.lit("x")))
    with pytest.raises(ValueError, match="none of the kernels"):
        jobs.train_kernel_svm(df.drop("label"), labels, kernel_svm.Settings(pca_components=2, kernels=("x", "y")))


def test_metrics_become_rows(spark):
    metrics = {"n": 3, "f": 0.5, "best": {"kernel": "rbf"}, "failed": ["a"], "classes": []}
    rows = {r["metric"]: r["value"] for r in kernel_svm.metric_rows(spark, metrics).collect()}
    assert rows == {"n": "3", "f": "0.500000", "best.kernel": "rbf", "failed[0]": "a"}


def test_only_training_rows_are_bounded(spark):
    rows = kernel_svm.split_rows(rings(spark), "seq_id", "label", "embedding", kernel_svm.Settings(per_class_limit=10))
    assert {(r["label"], r["part"]): r["count"] for r in rows.groupBy("label", "part").count().collect()} == {
        ("in", "train"): 10, ("out", "train"): 10, ("in", "test"): 15, ("out", "test"): 15
    }
