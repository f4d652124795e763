import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlake.models import dual, output, rounds, stacked
from cohortlake.models.dual import Machine, certificate, fit_machines, keyed
from cohortlake.models.linear import predict

BIAS = 3.0


def exact(x, sign, bound, steps=400_000):
    """Plain dual coordinate ascent in row order until nothing moves: weights with the bias last."""
    z = np.hstack([x, np.full((len(x), 1), BIAS)])
    alpha, w, norms = np.zeros(len(x)), np.zeros(z.shape[1]), (z**2).sum(axis=1)
    for _ in range(steps // len(x)):
        most = 0.0
        for i in range(len(x)):
            new = min(max(alpha[i] - (sign[i] * (w @ z[i]) - 1) / norms[i], 0.0), bound[i])
            most = max(most, abs(new - alpha[i]))
            w += (new - alpha[i]) * sign[i] * z[i]
            alpha[i] = new
        if most < 1e-10:
            break
    return w, alpha


def problem(spark, n=200, classes=2, width=3, seed=1, parts=3):
    rng = np.random.default_rng(seed)
    y = np.arange(n) % classes
    x = rng.normal(size=(n, width))
    x[np.arange(n), y % width] += 1.5
    w = np.where(y == 0, 2.0, 1.0)
    df = spark.createDataFrame(
        [(f"r{i}", float(a), float(b), c.tolist()) for i, (a, b, c) in enumerate(zip(y, w, x, strict=True))],
        "id string, __y double, __w double, __x array<double>",
    ).repartition(parts)
    return x, y, w, keyed(df, F.col("id"))


@pytest.mark.parametrize(("classes", "slice_bytes"), [(2, 16 << 20), (3, 16 << 20), (2, 300)])
def test_predictions_match_a_plain_solver(spark, monkeypatch, classes, slice_bytes):
    monkeypatch.setattr(dual, "SLICE_BYTES", slice_bytes)
    if slice_bytes < 1000:  # several partitions: one job per step
        monkeypatch.setattr(output, "_PARTITION_BYTES", 2400)
        monkeypatch.setattr(rounds, "CHUNK", 7)
    x, y, w, rows = problem(spark, classes=classes)
    machines = [Machine(1)] if classes == 2 else [Machine(k) for k in range(classes)]
    fit = fit_machines(rows, machines, 3, tolerance=1e-5)
    assert (np.abs(fit.gap) <= 1e-5).all()
    outputs = []
    for m, machine in enumerate(machines):
        sign = np.where(y == machine.positive, 1.0, -1.0)
        weights, alpha = exact(x, sign, w)
        value = (weights**2).sum() / 2 + (w * np.maximum(0, 1 - sign * (np.hstack([x, np.full((200, 1), BIAS)]) @ weights))).sum()
        assert fit.primal[m] == pytest.approx(value, rel=1e-4)
        outputs.append(x @ weights[:-1] + BIAS * weights[-1])
    expected = (outputs[0] > 0).astype(int) if classes == 2 else np.argmax(outputs, axis=0)
    labels = [f"c{k}" for k in range(classes)]
    got = {r["id"]: r["prediction"] for r in predict(fit.model(), rows, F.col("__x"), labels).collect()}
    close = np.abs(outputs[0]) < 1e-2 if classes == 2 else np.sort(outputs, axis=0)[-1] - np.sort(outputs, axis=0)[-2] < 1e-2
    assert all(got[f"r{i}"] == labels[k] for i, k in enumerate(expected) if not close[i]) and close.sum() < 5
    found = certificate(rows, fit.row_duals(rows), fit).collect()
    for r in found:
        assert r["n"] == 200 and r["outside"] == 0
        assert r["primal"] == pytest.approx(fit.primal[r["machine"]], rel=1e-6)
        assert r["dual"] == pytest.approx(fit.dual[r["machine"]], rel=1e-6)
        assert r["dual"] <= r["primal"] + 1e-9


def test_certificate_tells_wrong_answers_apart(spark):
    _, _, _, rows = problem(spark, n=40)
    fit = fit_machines(rows, [Machine(1)], 3)
    wrong = rows.select(F.col("__key").alias("key"), F.lit(0).alias("machine"), F.lit(0.5).alias("alpha"))
    r = certificate(rows, wrong, fit).first()
    assert r["dual"] < r["primal"] - 0.1 * abs(r["primal"]) and r["outside"] == 0
    assert certificate(rows, wrong.withColumn("alpha", F.lit(2.5)), fit).first()["outside"] == 40
    fit.weights[0] = fit.weights[0] * 0.5
    r = certificate(rows, fit.row_duals(rows), fit).first()
    assert r["primal"] - r["dual"] > 0.01 * r["primal"]


def test_feature_sets_are_fitted_as_if_alone(spark):
    x, y, w, rows = problem(spark, n=80)
    doubled = rows.withColumn("__x", F.concat("__x", F.transform("__x", lambda v: v * v)))
    both = fit_machines(doubled, [Machine(1, 0), Machine(1, 1, 0.5)], 3, sets=2, tolerance=1e-5)
    alone = fit_machines(rows, [Machine(1)], 3, tolerance=1e-5)
    assert both.primal[0] == pytest.approx(alone.primal[0], rel=1e-4)
    squared = fit_machines(rows.withColumn("__x", F.transform("__x", lambda v: v * v)), [Machine(1, 0, 0.5)], 3, tolerance=1e-5)
    assert both.primal[1] == pytest.approx(squared.primal[0], rel=1e-4)


def test_rows_of_zeros_and_one_class(spark):
    rows = keyed(spark.createDataFrame([(1.0, 1.0, [0.0]), (1.0, 1.0, [0.0])], "__y double, __w double, __x array<double>"))
    fit = fit_machines(rows, [Machine(1), Machine(0)], 1)
    assert (np.abs(fit.gap) < 1e-3).all()


def test_stacked_moments_and_gradients(spark):
    rng = np.random.default_rng(5)
    n = 150
    y, g, x = np.arange(n) % 3, rng.integers(0, 4, n), rng.normal(size=(n, 5)) * [1, 10, 0.1, 1, 0] + [0, 1e4, 0, 3, 2]
    df = spark.createDataFrame([(int(a), int(b), c.tolist()) for a, b, c in zip(g, y, x, strict=True)], "g int, y int, x array<double>").repartition(4)
    moments = stacked.group_moments(df, 4, 3)
    for k in range(4):
        assert np.allclose(moments.means[k], x[g == k].mean(0)) and np.allclose(moments.variances[k], x[g == k].var(0))
    designs = [moments.design(k, True, 1.0) for k in (0, 3, None)] + [moments.design(1, False, 0.3, keep=[0, 3])]
    for d in designs:
        seen = np.ones(n, dtype=bool) if d.excluded is None else g != d.excluded
        assert np.allclose(d.means, x[seen].mean(0)) and d.total == pytest.approx((d.class_weights[y[seen]]).sum())
    points = [rng.normal(size=(3, 6)) for _ in designs]
    sums = sum(stacked.summed([b], designs, points) for b in df.toArrow().to_batches())
    for d, p, (value, gradient) in zip(designs, points, stacked.losses(sums, designs, points), strict=True):
        def objective(q):
            seen = np.ones(n, dtype=bool) if d.excluded is None else g != d.excluded
            z = ((x[seen] - d.means) * d.inverse) @ q[:, :-1].T + q[:, -1]
            w = d.class_weights[y[seen]]
            loss = (w * (np.log(np.exp(z).sum(1)) - z[np.arange(len(z)), y[seen]])).sum() / d.total
            return loss + (q[:, :-1] ** 2).sum() / (2 * d.C * d.total)

        assert value == pytest.approx(objective(p))
        for c in range(3):
            for j in range(6):
                step = np.zeros_like(p)
                step[c, j] = 1e-6
                assert gradient[c, j] == pytest.approx((objective(p + step) - objective(p - step)) / 2e-6, abs=1e-5)


def test_all_models_share_each_job(spark, monkeypatch):
    _, y, _, rows = problem(spark, n=120, classes=3)
    data = rows.select((F.col("__y") % 2).cast("int").alias("g"), F.col("__y").cast("int").alias("y"), F.col("__x").alias("x"))
    moments = stacked.group_moments(data, 2, 3)
    designs = [moments.design(None, True, 1.0), moments.design(None, False, 0.1), moments.design(1, True, 1.0)]
    alone = [stacked.fit_stacked(data, [d], 3)[0] for d in designs]
    calls, old = [], rounds.added
    monkeypatch.setattr(output, "_PARTITION_BYTES", 1000)
    monkeypatch.setattr(rounds, "added", lambda parts, count: calls.append(count) or old(parts, count))
    together = stacked.fit_stacked(data, designs, 3)
    assert calls[0] == 3 and len(calls) < 60
    for a, b in zip(alone, together, strict=True):
        assert np.allclose(a.weights, b.weights, atol=1e-3)
