import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortlake.operators import features as feats
from cohortlake.operators import labels, quantiles
from cohortlake.operators.projection import fit_components, fit_scaling, log_ratio_column
from cohortlake.plans import jobs


def small(spark):
    inf = float("inf")
    rows = [("p1", "b", 1.0, 5.0, inf), ("p2", "a", None, 5.0, None), ("p3", "b", 4.0, 5.0, -inf), ("p4", "a", 3.0, 5.0, None)]
    df = spark.createDataFrame(rows, "sample_id string, label string, f1 double, f2 double, f3 double")
    return feats.coerce_numeric(df.withColumn("group_id", F.col("sample_id")), ["f1", "f2", "f3"])


def test_prepare_features(spark):
    rows, kept, dropped = jobs.prepare_features(small(spark), ["f1", "f2", "f3"])
    assert (kept, dropped) == (["f1"], ["f2", "f3"])
    got = {r["sample_id"]: (r["label_index"], r["features"]) for r in rows.collect()}
    assert got == {"p1": (1, [1.0]), "p2": (0, [3.0]), "p3": (1, [4.0]), "p4": (0, [3.0])}
    variance = feats.feature_variances(feats.impute(small(spark), {"f1": 3.0}), ["f1"], 0).first()["variance"]
    assert variance == pytest.approx(1.583333, abs=1e-6)
    with pytest.raises(ValueError, match="varies too little"):
        jobs.prepare_features(small(spark), ["f2", "f3"])
    with pytest.raises(ValueError, match="null"):
        jobs.prepare_features(small(spark).withColumn("label", F.lit(None).cast("string")), ["f1"])


def test_log_ratio(spark):
    row = [(1.0, math.e, 7.0)]
    df = spark.createDataFrame(row, "mgx_a double, mtx_b double, other double")
    chosen = feats.compositional(df.columns)
    out = feats.centred_log_ratio(df, chosen, 0.0).first()
    assert tuple(out) == pytest.approx((-0.5, 0.5, 7.0))
    vector = spark.createDataFrame([([1.0, math.e, 7.0],)], "v array<double>")
    assert vector.select(log_ratio_column(F.col("v"), [0, 1], 0.0).alias("v")).first()["v"] == pytest.approx([-0.5, 0.5, 7.0])


def test_exact_quantiles(spark):
    """Equal to numpy, with ties, skew and nulls."""
    rng = np.random.default_rng(3)
    groups = {
        "smooth": rng.normal(size=60_000),
        "ties": rng.integers(0, 4, size=20_000).astype(float),
        "hot": np.concatenate([np.full(30_000, 2.5), rng.exponential(size=20_000)]),
        "few": np.array([3.0, 1.0, 2.0, 10.0]),
        "one": np.array([4.0]),
    }
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("few", None), ("few", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(8)
    probs = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = {r["g"]: r for r in quantiles.exact_quantiles(df, "v", probs, ["g"], few_groups=True).collect()}
    for g, values in groups.items():
        assert got[g]["n"] == len(values)
        assert got[g]["quantiles"] == pytest.approx(np.quantile(values, probs), rel=1e-12)
    whole = quantiles.exact_quantiles(df, "v", [0.5]).first()["quantiles"][0]
    assert whole == pytest.approx(np.median(np.concatenate(list(groups.values()))), rel=1e-12)


def test_median_length_rule(spark):
    lengths = {"seqA": 11, "seqB": 8, "seqC": 7, "seqD": 8, "seqE": 7, "seqF": 8}
    df = spark.createDataFrame(list(lengths.items()), "seq_id string, length int")
    assert [r["seq_id"] for r in labels.rule_label(df, "length").filter("label = 1").collect()] == ["seqA"]
    with pytest.raises(ValueError, match="not a labelling rule"):
        labels.rule_label(df, "length", "other")


def test_statistics(spark):
    x = np.random.default_rng(1).normal(size=(300, 3))
    y = np.arange(300) % 2
    df = spark.createDataFrame([(str(k), *map(float, r)) for k, r in zip(y, x)], "label string, a double, b double, c double")
    names = ["a", "b", "c"]
    stats = {(r["label"], r["feature"]): r for r in feats.class_feature_stats(feats.to_long(df, names, ["label"]), "label").collect()}
    assert stats["1", "b"]["mean"] == pytest.approx(x[y == 1, 1].mean())
    assert stats["1", "b"]["std"] == pytest.approx(x[y == 1, 1].std())
    overall = {r["feature"]: r for r in feats.overall_feature_stats(feats.to_long(df, names)).collect()}
    assert overall["c"]["std"] == pytest.approx(x[:, 2].std(ddof=1))
    corr = {(r["feature_a"], r["feature_b"]): r["corr"] for r in feats.feature_correlation(df, names).collect()}
    assert corr["a", "c"] == pytest.approx(np.corrcoef(x.T)[0, 2]) and len(corr) == 9
    scaled = np.array([list(r) for r in feats.standardize(df, names).select(*names).collect()])
    assert np.allclose(scaled, (x - x.mean(0)) / x.std(0))
    scale = {r["feature"]: r for r in feats.robust_angle_scale(df, names, 0.5).collect()}
    assert scale["a"]["multiplier"] == pytest.approx(0.5 / np.percentile(np.abs(x[:, 0]), 90))
    whole = feats.robust_angle_scale(df, names, 0.5, per_feature=False).first()
    assert whole["p90"] == pytest.approx(np.percentile(np.abs(x), 90))
    zero = feats.robust_angle_scale(df.withColumn("a", F.lit(0.0)), ["a"], 0.5)
    assert zero.first()["multiplier"] == 0.5
    wide = feats.wide_class_table(feats.class_feature_stats(feats.to_long(df, names, ["label"]), "label"), "label", names, "mean").collect()
    assert wide[0]["a"] == pytest.approx(x[y == 0, 0].mean())


def test_histogram(spark):
    values = np.random.default_rng(2).integers(1, 500, size=400)
    df = spark.createDataFrame([(int(v),) for v in values], "length int")
    rows = feats.equal_width_histogram(df, "length").orderBy("bin").collect()
    counts, edges = np.histogram(values, bins=min(30, max(5, int(len(values) ** 0.5))))
    assert [r["count"] for r in rows] == counts.tolist()
    assert [r["left_edge"] for r in rows] == pytest.approx(edges[:-1])
    flat = feats.equal_width_histogram(spark.createDataFrame([(4,)] * 9, "length int"), "length").orderBy("bin").collect()
    counts, edges = np.histogram([4] * 9, bins=5)
    assert [r["count"] for r in flat] == counts.tolist()


def test_projection(spark):
    x = np.random.default_rng(4).normal(size=(200, 5)) @ np.diag([5, 3, 1, 1, 0.1])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, v array<double>")
    z = (x - x.mean(0)) / x.std(0)
    scaled = df.orderBy("id").select(fit_scaling(df, "v", [3, 1]).column(F.col("v")).alias("z")).collect()
    assert np.allclose([r["z"] for r in scaled], z[:, [3, 1]])
    components = fit_components(df, "v", 2)
    _, s, vt = np.linalg.svd(z, full_matrices=False)
    for axis, expected in zip(components.axes, vt):
        assert np.allclose(np.abs(axis), np.abs(expected)) and axis[int(np.abs(axis).argmax())] > 0
    assert components.explained == pytest.approx((s**2 / (s**2).sum())[:2])
    points = df.orderBy("id").select(components.column(F.col("v")).alias("p")).collect()
    assert np.allclose([r["p"] for r in points], z @ np.array(components.axes).T)
    assert len(fit_components(df, "v", 99).axes) == 5


def test_mutual_information(spark):
    rng = np.random.default_rng(6)
    y = rng.integers(0, 3, size=2000)
    data = {"signal": y + rng.normal(scale=0.3, size=2000), "noise": rng.normal(size=2000), "ties": (y == 1) * 1.0}
    df = spark.createDataFrame(
        [(str(a), *map(float, r)) for a, *r in zip(y, *data.values())], "label string, signal double, noise double, ties double"
    )
    rows = feats.mutual_information(df, "label", list(data)).orderBy("rank").collect()
    for r in rows:
        v = data[r["feature"]]
        bins = (v[:, None] > np.quantile(v, np.arange(1, 10) / 10)).sum(1)
        joint = np.array([[((bins == b) & (y == c)).mean() for c in range(3)] for b in range(10)])
        outer = joint.sum(1, keepdims=True) * joint.sum(0, keepdims=True)
        expected = (joint[joint > 0] * np.log(joint[joint > 0] / outer[joint > 0])).sum()
        assert r["mutual_information"] == pytest.approx(expected, abs=1e-9)
    assert rows[-1]["feature"] == "noise"
    long = feats.to_long(df, list(data), ["label"])
    assert feats.select_informative(long, "label", ["noise", "signal", "ties"], 2) == ["signal", "ties"]
    assert feats.select_informative(long, "label", ["noise"], None) == ["noise"]


def test_mean_pool_and_layout(spark):
    rows = [("s", "start", [9.0, 9.0]), ("s", "t", [1.0, 3.0]), ("s", "t", [3.0, 5.0]), ("s", "pad", [0.0, 0.0])]
    df = spark.createDataFrame(rows, "seq_id string, kind string, v array<double>")
    pooled = feats.mean_pool(df, "seq_id", "v", ~F.col("kind").isin("start", "pad", "end")).first()
    assert pooled["embedding"] == [2.0, 4.0]
    check = feats.layout_check(df.withColumn("n", F.array(F.lit("a"))), "n", "v").first()
    assert (check["orders"], check["consistent"]) == (1, True)


@pytest.mark.parametrize("width", [3, 20])
def test_correlation_with_gaps_and_constants(spark, width):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(60, width)) + 1e6
    x[:, 1] = 4.0
    x[::5, 2] = np.nan
    names = [f"f.{i}" for i in range(width)]
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in x]
    df = spark.createDataFrame(rows, "struct<" + ", ".join(f"`{n}`: double" for n in names) + ">").repartition(4)
    got = {(r["feature_a"], r["feature_b"]): r["corr"] for r in feats.feature_correlation(df, names).collect()}
    assert len(got) == width**2
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            if 1 in (i, j):
                assert got[a, b] is None
            else:
                assert got[a, b] == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-9)
    vectors = df.select(F.array(*[F.col(f"`{n}`") for n in names]).alias("v"))
    assert {(r["feature_a"], r["feature_b"]): r["corr"] for r in feats.vector_correlation(vectors, "v", names).collect()} == pytest.approx(got)


def test_quantiles_of_small_and_large_groups(spark):
    rng = np.random.default_rng(5)
    sizes = {"one": 1, "two": 2, "few": 7, "many": 150_000}
    values = {g: np.round(rng.normal(size=n) * (100 if g == "many" else 1), 3) for g, n in sizes.items()}
    rows = [(g, float(v)) for g, own in values.items() for v in own] + [("few", None), ("few", float("nan"))]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["g", "v"])).repartition(4)
    probs = [0.0, 0.25, 0.5, 0.999, 1.0]
    for few in (False, True):
        for r in quantiles.exact_quantiles(df, "v", probs, ["g"], few_groups=few).collect():
            assert r["n"] == sizes[r["g"]] and r["quantiles"] == pytest.approx(np.quantile(values[r["g"]], probs).tolist())
