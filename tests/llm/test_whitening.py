import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlake.llm.spectrum import count_above, eigenpairs_within, intervals, located, tridiagonal
from cohortlake.llm.whitening import whitened

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, components):
    """{row position: (deviation, whitened up to sign)} by exact integers and a dense eigensolver."""
    good = []
    for at, (_, v) in enumerate(rows):
        if v and all(c is not None and math.isfinite(c) for c in v):
            good.append((at, tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v)))
    fit = sorted({x for _, x in good})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    matrix = np.array(fit, dtype=float) - np.array(sums) / n
    cov = matrix.T @ matrix / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    kept = [i for i in range(min(components, len(values))) if values[i] > 1e-12 * np.trace(cov)]
    out = {}
    for at, x in good:
        centre = np.array(x, dtype=float) - np.array(sums) / n
        out[at] = sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)), [
            abs(centre @ vectors[:, i]) / math.sqrt(values[i]) for i in kept
        ]
    return n, out, [values[i] / np.trace(cov) for i in kept]


@pytest.mark.parametrize("width", [3, 24])
def test_matches_a_dense_solver(spark, width):
    rng = np.random.default_rng(width)
    rows = [(i, (rng.normal(size=width) * np.linspace(1, 2, width)).tolist()) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(150)]  # copies count once in the fit
    rows += [(None, [0.25] * width), (5, rows[5][1])]
    expected_n, expected, shares = brute(rows, 16)
    bad = [(900, None), (901, [float("nan")] * width), (902, [None] * width), (903, [float("inf")] * width)]
    bad += [(904, []), (905, [1.0]), (906, [3e38] * width)]
    df = spark.createDataFrame(rows + bad, SCHEMA).withColumn("x", F.lit("clash")).withColumn("n", F.lit(1)).repartition(4)
    got = whitened(df).collect()
    assert len(got) == len(expected) * len(shares)
    assert {r["n"] for r in got} == {expected_n}
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9
    by_id = {}
    for at, (ident, _) in enumerate(rows):
        by_id.setdefault(ident, at)
    signs = {}
    for r in got:
        deviation, values = expected[by_id[r["vec_id"]]]
        c = r["component"]
        assert r["deviation"] == deviation
        assert abs(r["whitened"]) == pytest.approx(values[c - 1], abs=1e-8)
        assert r["explained"] == pytest.approx(shares[c - 1], rel=1e-9)
        signs.setdefault((r["vec_id"], c), set()).add(np.sign(r["whitened"]))
    assert all(len(s) == 1 for s in signs.values())


def test_flat_and_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert whitened(empty).collect() == []
    assert whitened(spark.createDataFrame([(1, None), (2, [])], SCHEMA)).collect() == []
    assert whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], SCHEMA)).collect() == []
    line = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(5)], SCHEMA)
    got = whitened(line).collect()
    assert len(got) == 5 and {r["component"] for r in got} == {1}
    assert got[0]["explained"] == pytest.approx(1.0)


def test_deviations_beyond_a_long_are_null(spark):
    rows = [(0, [0.0]), (1, [2.0**40]), (2, [1.0])]
    got = {r["vec_id"]: r["deviation"] for r in whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got[1] is None and got[0] is None
    small = {r["vec_id"]: r["deviation"] for r in whitened(spark.createDataFrame([(0, [0.0]), (1, [2.0**20])], SCHEMA)).collect()}
    assert small == {0: (64 * 2**20) ** 2, 1: (64 * 2**20) ** 2}


def test_clusters_are_found_whole():
    rng = np.random.default_rng(4)
    basis, _ = np.linalg.qr(rng.normal(size=(20, 20)))
    spectrum = np.r_[[5.0] * 6, [4 + 1e-9] * 3, np.linspace(1, 3, 11)]
    matrix = basis @ np.diag(spectrum) @ basis.T
    matrix = (matrix + matrix.T) / 2
    diagonal, off = tridiagonal(matrix)
    assert np.abs(located(diagonal, off, 20) - np.sort(spectrum)[::-1]).max() < 1e-8
    assert count_above(diagonal, off, np.array([4.5, 3.5, 0.5])).tolist() == [6, 9, 20]
    parts = intervals(matrix, 8)
    assert [c for *_, c in parts] == [6, 3]
    for low, high, count in parts:
        values, vectors = eigenpairs_within(matrix, low, high, count)
        assert np.abs(matrix @ vectors - vectors * values).max() < 1e-13
        assert np.abs(vectors.T @ vectors - np.eye(count)).max() < 1e-13
