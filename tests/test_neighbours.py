import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlake.operators import neighbours
from cohortlake.operators.neighbours import digamma, neighbour_information


def harmonic(n):
    return -0.5772156649015329 + sum(1.0 / i for i in range(1, n))


def brute(rows, k):
    """{feature: (n, information)} point by point."""
    out = {}
    for f in {r[1] for r in rows if r[1] is not None}:
        points = [(c, v) for c, g, v in rows if g == f and c is not None and v is not None and not math.isnan(v)]
        sizes = {c: sum(a == c for a, _ in points) for c, _ in points}
        points = [(c, v) for c, v in points if sizes[c] > 1]
        if not points:
            continue
        total = 0.0
        for i, (c, v) in enumerate(points):
            need = min(k, sizes[c] - 1)
            r = sorted(abs(w - v) for j, (d, w) in enumerate(points) if d == c and j != i)[need - 1]
            m = sum((w > v - r and w < v + r) if r else w == v for _, w in points)
            total += harmonic(need) - harmonic(sizes[c]) - harmonic(m)
        out[f] = len(points), max(0.0, harmonic(len(points)) + total / len(points))
    return out


def sample(seed, n):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        label = ["a", "b", "c"][int(rng.integers(3))]
        shift = {"a": 0, "b": 3, "c": 9}[label]
        rows.append((label, "telling", float(round(shift + rng.normal() * 2, 2))))
        rows.append((label, "noise", float(rng.integers(0, 1000))))
        rows.append((label, "ties", float(rng.integers(0, 4))))
        rows.append((label, "hot", 7.0 if i % 3 else float(rng.integers(0, 50))))
        rows.append((label, "constant", 1.0))
    return rows + [("alone", "noise", 5.0), (None, "noise", 5.0), ("a", "noise", None), ("a", "noise", float("nan")), ("a", None, 1.0), ("few", "noise", 3.0), ("few", "noise", 8.0)]


@pytest.mark.parametrize(("k", "cells"), [(3, 50_000), (3, 7), (1, 20), (5, 2)])
def test_matches_brute_force_across_ranges(spark, monkeypatch, k, cells):
    monkeypatch.setattr(neighbours, "RANGE_CELLS", cells)
    rows = sample(k, 120)
    got = neighbour_information(spark.createDataFrame(rows, "lab string, feature string, value double").repartition(4), "lab", k).collect()
    expected = brute(rows, k)
    assert {r["feature"]: r["n"] for r in got} == {f: n for f, (n, _) in expected.items()}
    for r in got:
        assert r["mutual_information"] == pytest.approx(expected[r["feature"]][1], abs=1e-8)
    assert next(r["feature"] for r in got if r["rank"] == 1) == "telling"


def test_empty_and_unusable_tables(spark):
    schema = "label string, feature string, value double"
    assert neighbour_information(spark.createDataFrame([], schema), "label").collect() == []
    assert neighbour_information(spark.createDataFrame([("a", "f", 1.0), ("b", "f", 2.0)], schema), "label").collect() == []


def test_digamma(spark):
    df = spark.createDataFrame([(n,) for n in (1, 2, 3, 10, 1000)], "n long").select("n", digamma(F.col("n")).alias("d"))
    for r in df.collect():
        assert r["d"] == pytest.approx(harmonic(r["n"]), abs=1e-11)
