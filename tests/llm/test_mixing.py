import random

import numpy as np
import pyarrow as pa
from pyspark.sql import Row
from pyspark.sql import functions as F

from cohortlake.llm.mixing import fit_domains, fit_rates, mix, mixed, rates_after


def tables(spark):
    rng = random.Random(6)
    letters = {"a": "aeionrst", "b": "ouqkzvwx", "c": "ыавпролд"}
    rows = []
    for i in range(300):
        domain = "a" if i % 10 < 6 else "b" if i % 10 < 9 else "c"
        words = ["".join(rng.choice(letters[domain]) for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(5, 90))]
        rows.append((i, " ".join(words), domain))
    edges = [(901, None), (902, ""), (None, "aeio nrst"), (903, "ouqk " * 5000), (5, rows[5][1])]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + edges, "doc_id long, text string")
    labels = spark.createDataFrame([(i, d) for i, _, d in rows if i % 2] + [(None, "a"), (7, None)], "doc_id long, domain string")
    return rows, docs.withColumn("domain", F.lit("clash")).repartition(4), labels


def test_expected_tokens_match_targets(spark):
    rows, docs, labels = tables(spark)
    targets = {"a": 0.3, "b": 0.3, "c": 0.4}
    found = mix(docs, labels, targets).toPandas()
    assert len(found) == docs.count() and (found["__rate"] >= 0).all()
    tokens = found["__tokens"].to_numpy() * found["__rate"].to_numpy()
    expected = tokens @ np.array(found["__posterior"].tolist())
    assert np.allclose(expected / found["__tokens"].sum(), [0.3, 0.3, 0.4], atol=2e-3)
    off = (found["__copies"] - found["__rate"]).abs()
    assert (off < 1).all()
    truth = {i: d for i, _, d in rows}
    named = found[found["doc_id"].notna() & (found["doc_id"] < 300)]
    assert np.mean([truth[i] == d for i, d in zip(named["doc_id"], named["__domain"])]) > 0.98
    again = mixed(docs, labels, targets)
    assert again.columns == docs.columns and again.count() == found["__copies"].sum()


def test_steps_match_a_plain_solver(spark):
    rng = np.random.default_rng(1)
    posterior = rng.dirichlet([0.4, 0.4, 0.4], 200)
    tokens = rng.integers(1, 50, 200)
    targets = np.array([0.1, 0.7, 0.2]) * tokens.sum()
    df = spark.createDataFrame([(int(t), p.tolist()) for t, p in zip(tokens, posterior)], "tokens long, posterior array<double>")
    fit = fit_rates(df.repartition(3), targets, tolerance=1e-6, steps=200)
    rates, expected = rates_after(fit.steps, posterior), fit.reached
    assert np.allclose((tokens * rates) @ posterior, expected) and np.allclose(expected, targets, rtol=1e-3)
    # Projected gradient without momentum from the same start reaches the same distance.
    plain, step = np.ones(200), 1 / np.linalg.eigvalsh((posterior * tokens[:, None]).T @ posterior)[-1]
    for _ in range(3000):
        plain = np.maximum(0, plain - step * posterior @ ((tokens * plain) @ posterior - targets))
    assert np.abs((tokens * plain) @ posterior - targets).max() < 1e-3 * tokens.sum()


def test_rare_domains_reach_their_targets(spark):
    targets = np.array([0.4, 0.2, 0.2, 0.2]) * 1e6
    for shares in ([0.9, 0.07, 0.025, 0.005], [0.95, 0.04, 0.009, 0.001]):
        rows = [(round(s * 1e6), np.eye(4)[i].tolist()) for i, s in enumerate(shares)]
        df = spark.createDataFrame(rows, "tokens long, posterior array<double>")
        assert np.allclose(fit_rates(df, targets).reached, targets, atol=100)


class Rows:
    """Stands in for a table whose tasks run at once: the fit's sums over many small cases."""

    def __init__(self, batches):
        self.batches = batches

    def select(self, *_):
        return self

    def mapInArrow(self, f, _):
        return Rows([b for own in self.batches for b in f(iter([own]))])

    def groupBy(self, _):
        return self

    def agg(self, _):
        return self

    def collect(self):
        sums = {}
        for b in self.batches:
            for place, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums[place] = sums.get(place, 0.0) + value
        return [Row(place=p, value=v) for p, v in sums.items()]

    def first(self):
        return [sum(b.column(0).to_pylist()[0] for b in self.batches)]


def test_any_targets_give_rates_and_a_small_residual():
    """300 random cases, reachable or not: no exception, and no step would move the rates much."""
    rng = np.random.default_rng(0)
    missed = 0
    for _ in range(300):
        k, n = int(rng.integers(2, 7)), int(rng.integers(20, 300))
        posterior, tokens = rng.dirichlet(np.full(k, rng.choice([0.05, 0.3, 1, 3])), n), rng.integers(0, 200, n)
        tokens[0] += 1
        targets = rng.dirichlet(np.ones(k) * rng.choice([0.3, 1, 5])) * tokens.sum()
        halves = [slice(0, n // 2), slice(n // 2, n)]
        data = Rows([pa.record_batch([pa.array(tokens[h]), pa.array(list(posterior[h]))], names=["tokens", "posterior"]) for h in halves])
        fit = fit_rates(data, targets)
        rates = rates_after(fit.steps, posterior)
        assert (rates >= 0).all() and np.allclose((tokens * rates) @ posterior, fit.reached)
        far = np.abs(fit.reached - targets).max() > 1e-4 * tokens.sum()
        missed += far
        assert not far or fit.residual <= 1e-3
    assert 0 < missed < 150


def test_fit_leaves_no_cached_rows_and_keeps_clashing_columns(spark):
    _, docs, labels = tables(spark)
    clash = docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(("__draw", "__tokens", "__rate", "__posterior", "row", "copies", "a.b"))])
    held = len(spark.sparkContext._jsc.getPersistentRDDs())
    again = mixed(clash, labels, {"a": 0.5, "b": 0.25, "c": 0.25})
    assert again.columns == clash.columns and {tuple(r)[3:] for r in again.collect()} == {(0, 1, 2, 3, 4, 5, 6)}
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) <= held


def test_unreachable_and_missing_domains(spark):
    _, docs, labels = tables(spark)
    found = mix(docs, labels, {"a": 0.5, "nowhere": 0.5}).toPandas()
    assert np.isfinite(found["__rate"]).all() and found.groupby("__domain")["__rate"].mean()["a"] > 1
    none = mix(docs, labels.limit(0), {"a": 1.0}).toPandas()
    assert (none["__rate"] == 1).all() and (none["__copies"] == 1).all()
    assert mix(docs.limit(0), labels, {"a": 1.0}).collect() == []


def test_model_is_soft(spark):
    _, docs, labels = tables(spark)
    model = fit_domains(docs, labels)
    sure, unsure = model.posteriors(["aeion rstae nostra", "zzz"])[:, 0], model.posteriors([""])
    assert sure[0] > 0.9 and np.allclose(unsure.sum(), 1) and np.allclose(unsure, np.exp(model.log_prior))


def test_rates_of_the_mixed_rows_are_computed_once(spark):
    _, docs, labels = tables(spark)
    rows = mixed(docs, labels, {"a": 0.3, "b": 0.3, "c": 0.4})
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1  # each would take Python workers of its own
