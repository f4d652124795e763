import itertools
import random

import pytest

from cohortlake.operators import metrics
from cohortlake.operators.curves import ranking_quality

# Published confusion matrices (rows true, columns predicted) and their scores.
COHORT = (["control", "flare", "remission"], [[164, 1, 35], [11, 70, 9], [57, 22, 400]])
ENZYMES = (["1", "2"], [[16, 8], [11, 13]])


def predictions(spark, labels, matrix):
    rows = [(t, p) for i, t in enumerate(labels) for j, p in enumerate(labels) for _ in range(matrix[i][j])]
    return spark.createDataFrame(rows, "label string, prediction string")


def test_published_scores(spark):
    df = predictions(spark, *COHORT)
    total = metrics.summary_scores(metrics.class_scores(df, "label", "prediction")).first()
    expected = {
        "accuracy": 0.8244473342002601,
        "balanced_accuracy": 0.8109502822237685,
        "precision_macro": 0.7868285415560164,
        "recall_macro": 0.8109502822237685,
        "f1_macro": 0.7970084921905133,
        "precision_weighted": 0.8330985401303381,
        "recall_weighted": 0.8244473342002601,
        "f1_weighted": 0.8268819785814483,
    }
    for name, value in expected.items():
        assert total[name] == pytest.approx(value, abs=1e-12)
    tidy = {r["metric"]: r["value"] for r in metrics.performance_table(df, "label", "prediction").collect()}
    assert tidy == pytest.approx({k: v for k, v in expected.items() if k != "balanced_accuracy"})
    labels, matrix = COHORT
    wide = metrics.confusion_wide(metrics.confusion_matrix(df, "label", "prediction"), labels).collect()
    assert [list(r)[1:] for r in wide] == matrix
    small = predictions(spark, *ENZYMES)
    second = metrics.summary_scores(metrics.class_scores(small, "label", "prediction")).first()
    assert second["f1_macro"] == pytest.approx(0.6026143790849673, abs=1e-12)
    assert second["accuracy"] == pytest.approx(0.6041666666666666, abs=1e-12)
    assert metrics.accuracy(small, "label", "prediction").first()[0] == pytest.approx(29 / 48)


def test_label_union_and_zero_division(spark):
    df = spark.createDataFrame([("a", "b"), ("a", "a"), ("c", "b")], "label string, prediction string")
    cells = {(r["true_label"], r["pred_label"]): r["count"] for r in metrics.confusion_matrix(df, "label", "prediction").collect()}
    assert len(cells) == 9 and cells["a", "b"] == 1 and cells["b", "b"] == 0
    scores = {r["label"]: r for r in metrics.class_scores(df, "label", "prediction").collect()}
    assert (scores["b"]["precision"], scores["b"]["recall"], scores["b"]["f1"], scores["b"]["support"]) == (0, 0, 0, 0)
    assert scores["c"]["precision"] == 0 and scores["a"]["f1"] == pytest.approx(2 / 3)
    total = metrics.summary_scores(metrics.class_scores(df, "label", "prediction")).first()
    # Balanced accuracy averages over true classes only, macro recall over the union.
    assert total["balanced_accuracy"] == pytest.approx(0.25) and total["recall_macro"] == pytest.approx(0.5 / 3)
    report = [r["label"] for r in metrics.classification_report(df, "label", "prediction").collect()]
    assert sorted(report) == ["a", "accuracy", "b", "c", "macro avg", "weighted avg"]


def brute_auc(rows):
    pos = [s for s, y in rows if y]
    neg = [s for s, y in rows if not y]
    wins = sum((p > n) + 0.5 * (p == n) for p, n in itertools.product(pos, neg))
    return wins / (len(pos) * len(neg))


def brute_ap(rows):
    total, out, before = sum(y for _, y in rows), 0.0, 0
    for s in sorted({s for s, _ in rows}, reverse=True):
        at_least = [y for x, y in rows if x >= s]
        out += (sum(at_least) - before) / total * sum(at_least) / len(at_least)
        before = sum(at_least)
    return out


def test_ranking_quality(spark):
    rng = random.Random(9)
    groups = {
        "ties": [(rng.randint(0, 5) / 5, rng.randint(0, 1)) for _ in range(300)],
        "smooth": [(rng.random(), rng.randint(0, 1)) for _ in range(400)],
        "hot": [(0.5, rng.randint(0, 1)) for _ in range(300)] + [(rng.random(), 1) for _ in range(50)],
        "one_class": [(0.1, 1), (0.2, 1)],
    }
    df = spark.createDataFrame([(g, *r) for g, rows in groups.items() for r in rows], "g string, s double, y int")
    got = {r["g"]: r for r in ranking_quality(df.repartition(5), "s", "y", ["g"]).collect()}
    for g in ("ties", "smooth", "hot"):
        assert got[g]["roc_auc"] == pytest.approx(brute_auc(groups[g]))
        assert got[g]["average_precision"] == pytest.approx(brute_ap(groups[g]))
    assert got["one_class"]["roc_auc"] is None and got["one_class"]["average_precision"] is None


def test_probability_metrics(spark):
    rows = [("a", "a", 0.9, 0.1), ("b", "b", 0.2, 0.8), ("a", "b", 0.4, 0.6), ("b", "b", 0.45, 0.55)]
    df = spark.createDataFrame(rows, "label string, prediction string, pa double, pb double")
    tidy = {r["metric"]: r["value"] for r in metrics.performance_table(df, "label", "prediction", {"a": "pa", "b": "pb"}).collect()}
    assert tidy["roc_auc"] == pytest.approx(0.75) and tidy["average_precision"] == pytest.approx((1 + 2 / 3) / 2)
    three = {"a": "pa", "b": "pb", "c": "pc"}
    more = df.selectExpr("*", "cast(null as double) pc")
    tidy = {r["metric"]: r["value"] for r in metrics.performance_table(more, "label", "prediction", three).collect()}
    # The class without positives has no area and takes no part in the mean.
    assert tidy["roc_auc"] == pytest.approx(0.75) and "average_precision" not in tidy


def test_scores_that_are_missing_or_infinite(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(inf, 1), (inf, 0), (2.0, 1), (1.0, 0), (-inf, 0), (nan, 1), (None, 0)]
    got = ranking_quality(spark.createDataFrame(rows, "s double, y int"), "s", "y").first()
    assert got["roc_auc"] == pytest.approx((2.5 + 2) / 6)
    assert got["average_precision"] == pytest.approx((1 / 2 + 2 / 3) / 2)


def test_fixed_labels_give_all_their_cells(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (0, 2)], "label int, prediction int")
    cells = {(r["true_label"], r["pred_label"]): r["count"] for r in metrics.confusion_matrix(df, "label", "prediction", [0, 1]).collect()}
    assert cells == {(0, 0): 2, (0, 1): 0, (1, 0): 0, (1, 1): 0}
