"""Toxicity, quality and language: held-out accuracy on generated texts, folding, edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlake.llm.common import chosen_rows, decided, fit_logistic, learned_labels, logistic
from cohortlake.llm.language import UNKNOWN, fit_language, languages_of
from cohortlake.llm.quality import QualityModel, fit_quality, quality_filtered, quality_scores
from cohortlake.llm.toxicity import Folds, automaton, fit_toxicity, fold, hits, toxicity_scores

EDGES = [(9001, None), (9002, ""), (9003, "   \n"), (None, "nameless words"), (9004, "1234 56 !!"), (9005, "word " * 20_000)]


def words(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(n))


def corpus(kind):
    n = 480 if kind == "toxic" else 240
    rng = random.Random(kind)
    rows = []
    for i in range(n):
        text, label = words(rng, "aeionrstdl", rng.randint(30, 120)), int(i % 3 == 0)
        if kind == "toxic" and label:
            text = text.split()
            for _ in range(3):
                text[rng.randrange(len(text))] = rng.choice(["scumbag", "sсumbag", "5cumb4g", "SCUMBAGS", "moronic", "m0ronic"])
            text = " ".join(text)
        elif kind == "toxic" and i % 60 == 1:
            text += " the moronic acid test was moronic acid again"
        elif kind == "quality" and not label:
            text = "CLICK HERE!!! $$$ " * rng.randint(5, 30) + text[:30].upper()
        elif kind == "lang":
            label = ("xx", "yy", "zz")[i % 3]
            text = words(rng, ("aeionrst", "ouqkzvwx", "ыавпролд")[i % 3], 40)
        rows.append((i, text, label))
    return rows


def tables(spark, kind):
    rows = corpus(kind)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + EDGES, "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, None), (9001, None)], "doc_id long, y " + ("string" if kind == "lang" else "int"))
    return rows, docs.withColumn("label", F.lit("clash")).withColumn("score", F.lit("clash")).repartition(4), labels


def checked(scores, rows, bound, modulus, held):
    found = {r.doc_id: r for r in decided(scores, modulus, held, bound).collect()}
    assert len(found) == len(rows) + len(EDGES) and all(0 <= r.score <= 1 for r in found.values())
    own = [(found[i], y) for i, _, y in rows if found[i].held_out]
    assert len(own) > 20
    return np.mean([r.predicted == y for r, y in own])


def test_toxicity(spark):
    rows, docs, labels = tables(spark, "toxic")
    model = fit_toxicity(docs, learned_labels(labels, 4, 2), "y", least_odds=3.0)
    assert {" scumb", " moronic "} <= set(model.weights) and any("acid" in e for e in model.exceptions)
    assert checked(toxicity_scores(docs, model), rows, 0.3, 4, 2) > 0.97


def test_folding_and_exceptions():
    folds = Folds()
    assert fold("Sсum, 5CUM ѕ¢ 4 123 l0l", folds).split()[:2] == ["scum", "scum"]
    assert fold("Ｆｕｌｌ w​idth É", folds) == " fuii width e "
    assert fold("", folds).split() == []
    machine = automaton({" scum ": 2.0, " scu": 1.0}, {" pond scum "})
    assert hits(" scum of pond scum scur ", machine) == [(0, 2.0), (18, 1.0)]
    assert hits(" scum ", automaton({}, set())) == []


def test_quality(spark):
    rows, docs, labels = tables(spark, "quality")
    model = fit_quality(docs, learned_labels(labels, 3, 1), "y")
    assert checked(quality_scores(docs, model), rows, 0.5, 3, 1) > 0.97
    kept = quality_filtered(docs, model, 0.5)
    scores = quality_scores(docs, model).filter("score >= 0.5")
    assert kept.columns == docs.columns and kept.count() == scores.count()


def test_whole_rows_are_scored_with_one_copy_of_their_text(spark):
    model = QualityModel(b"good words " * 50, b"bad noise " * 50, (9.0, 0.0))
    rows = [(1, "good words good words"), (2, "bad noise bad noise"), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain, other = quality_filtered(docs, model, 0.5), quality_filtered(docs.withColumn("text", F.col("text").cast("binary")), model, 0.5)
    assert sorted(map(tuple, plain.collect())) == [(1, rows[0][1]), (3, None), (4, "")]
    assert sorted((r.doc_id, None if r.text is None else bytes(r.text).decode()) for r in other.collect()) == [(1, rows[0][1]), (3, None), (4, "")]
    assert "__text" not in plain._jdf.queryExecution().executedPlan().toString()


def test_language(spark):
    rows, docs, labels = tables(spark, "lang")
    model = fit_language(docs, learned_labels(labels, 4, 2), "y")
    found = {r.doc_id: r for r in languages_of(docs, model).collect()}
    assert all(found[i].lang_pred == y for i, _, y in rows)
    assert all(found[i].lang_pred == UNKNOWN and found[i].rejected for i in (9001, 9002, 9003, 9004))
    odd = languages_of(spark.createDataFrame([(1, "日本語の文章です")], "doc_id long, text string"), model).first()
    assert odd.rejected and odd.lang_pred in ("xx", "yy", "zz")


@pytest.mark.parametrize("keep", ["doc_id < 0", "y = 1"])
def test_no_or_one_class(spark, keep):
    for kind, fit, score in (("toxic", fit_toxicity, toxicity_scores), ("quality", fit_quality, quality_scores)):
        _, docs, labels = tables(spark, kind)
        scores = score(docs, fit(docs, labels.filter(keep), "y")).collect()
        assert len(scores) == docs.count() and all(0 <= r.score <= 1 for r in scores)
    _, docs, labels = tables(spark, "lang")
    empty = fit_language(docs, labels.filter("doc_id < 0"), "y")
    assert {r.lang_pred for r in languages_of(docs, empty).collect()} == {UNKNOWN}
    assert languages_of(docs.limit(0), empty).collect() == []


def test_chosen_rows(spark):
    labels = spark.range(4000).selectExpr("id as doc_id", "int(id % 10 = 0) as y").unionByName(
        spark.createDataFrame([(None, 1), (5, None), (5, 1)], "doc_id long, y int")
    )
    got = chosen_rows(labels, "y", 500).collect()
    sizes = {y: sum(r.label == y for r in got) for y in (0, 1)}
    assert sizes[1] == 401 and abs(sizes[0] - 500) < 100
    assert {round(r.weight, 3) for r in got if r.label == 0} == {round(3599 / 500, 3)}


def test_logistic_reaches_the_optimum():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 2))
    y = (x @ [2.0, -1.0] + rng.normal(size=300) > 0).astype(float)
    beta = fit_logistic(x, y, np.ones(300))
    slope = np.hstack([x, np.ones((300, 1))]).T @ (logistic(x, beta) - y) + 0.3 * np.r_[beta[:2], 0]
    assert np.abs(slope).max() < 1e-6


def test_hits_sweep_long_texts_with_many_exceptions():
    import time

    from cohortlake.llm.toxicity import automaton, hits

    machine = automaton({" bad ": 2.0, " bad": 1.0}, {" not bad ", " bad luck "})
    assert hits(" not bad bad bad luck badly ", machine) == [(8, 2.0), (21, 1.0)]
    long = " not bad" * 150_000 + " bad "
    began = time.perf_counter()
    assert hits(long, machine) == [(8 * 150_000, 2.0)]
    assert time.perf_counter() - began < 5


def test_toxicity_defaults_work_with_ten_clean_rows(spark):
    from cohortlake.llm.toxicity import fit_toxicity

    rows = [(i, f"plain text number w{i} snarkle" if i < 30 else f"plain text number w{i}", int(i < 30)) for i in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    assert " snarkie " in fit_toxicity(docs, labels).weights  # l folds to i
