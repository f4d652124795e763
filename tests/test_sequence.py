import random

import pytest
from pyspark.sql import functions as F

from cohortlake.functions import sequence as seq
from cohortlake.functions.embedders import embedder, register_embedder
from cohortlake.plans import jobs


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "s string").select(column.alias("v")).first()["v"]


def test_composition_vectors(spark):
    zeros = one(spark, "acgt", seq.composition(F.col("s")))
    assert zeros == [0.0] * 64 == one(spark, "", seq.composition(F.col("s")))
    glycine = one(spark, "GGGGGGGG", seq.composition(F.col("s")))
    assert [i for i, v in enumerate(glycine) if v] == [5, 25, 45] and glycine[5] == 1.0
    pair = one(spark, "AC", seq.composition(F.col("s")))
    assert [i for i, v in enumerate(pair) if v] == [0, 1, 20, 21, 40, 41, 60, 61]
    assert pair[0] == pytest.approx(0.70710678)
    assert one(spark, None, seq.composition(F.col("s"))) == [0.0] * 64


@pytest.mark.parametrize(
    "header, expected",
    [
        ("sp|A0A061I403|FICD_CRIGR x", "A0A061I403"),
        (">tr|Q9XYZ1|N", "Q9XYZ1"),
        ("P12345 some desc", "P12345"),
        ("xx|Y|Z", "xx|Y|Z"),
    ],
)
def test_accession(spark, header, expected):
    assert one(spark, header, seq.accession(F.col("s"))) == expected


@pytest.mark.parametrize(
    "field, expected", [("3.4.1.-; 1.1.1.1", 3), ("n/a", None), ("", None), (None, None), (" 7.1", 7), ("12.1", None)]
)
def test_top_enzyme_class(spark, field, expected):
    assert one(spark, field, seq.top_enzyme_class(F.col("s"))) == expected


def test_cleaning(spark):
    raw = "ABZJ*U-!acgt??é"
    assert one(spark, raw, seq.letters_only(F.col("s"))) == "ABZJUACGT"
    assert one(spark, raw, seq.sanitized(F.col("s"))) == "ABZJXACGT"
    rows = spark.createDataFrame([("a", raw), ("b", "mkv"), ("c", ""), ("d", None)], "seq_id string, sequence string")
    strict = {r["seq_id"]: r for r in jobs.validate_sequences(rows).collect()}
    assert strict["a"]["ok"] is False and strict["a"]["rejected"] == ["U"] and strict["a"]["sequence"] is None
    assert strict["b"]["ok"] and strict["b"]["sequence"] == "MKV" and strict["c"]["sequence"] == ""
    assert strict["d"]["sequence"] is None
    loose = {r["seq_id"]: r for r in jobs.validate_sequences(rows, sanitize=True, limit=1).collect()}
    assert list(loose) == ["a"] and loose["a"]["ok"] and loose["a"]["sequence"] == "ABZJXACGT"


def brute_positions(text, pattern):
    if not pattern or len(pattern) > len(text):
        return []
    return [i for i in range(len(text) - len(pattern) + 1) if text[i : i + len(pattern)] == pattern]


@pytest.mark.parametrize(
    "text, pattern, expected",
    [("ACGTAC", "GTA", [2]), ("ABABA", "ABA", [0, 2]), ("AAAA", "AA", [0, 1, 2]), ("AB", "ABC", []), ("AB", "", [])],
)
def test_pattern_goldens(spark, text, pattern, expected):
    rows = spark.createDataFrame([(1, text)], "id int, t string")
    found = sorted(r["position"] for r in seq.pattern_positions(rows, ["id"], "t", [pattern]).collect())
    assert found == expected
    assert rows.select(seq.match_count(F.col("t"), pattern).alias("n")).first()["n"] == len(expected)


def test_patterns_against_brute_force(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abé.\\E") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    patterns = ["a", "aa", "aba", "é", "\\E", ".", "éaé", "b.b"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    found = {(r["id"], r["pattern"], r["position"]) for r in seq.pattern_positions(rows, ["id"], "t", patterns).collect()}
    assert found == {(i, p, x) for i, t in enumerate(texts) for p in patterns for x in brute_positions(t, p)}
    counts = rows.select("id", *[seq.match_count(F.col("t"), p).alias(f"c{k}") for k, p in enumerate(patterns)]).collect()
    for r in counts:
        assert [r[f"c{k}"] for k in range(len(patterns))] == [len(brute_positions(texts[r["id"]], p)) for p in patterns]
    top = jobs.top_matches(rows, "id", "t", patterns, 8).collect()
    best = sorted(((-len(brute_positions(t, p)), i, p) for i, t in enumerate(texts) for p in patterns))[:8]
    assert [(-r["n"], r["id"], r["pattern"]) for r in top] == best


def test_embedder_registry(spark):
    assert embedder("").backend == embedder(None).backend == embedder("DUMMY").backend == "dummy"
    with pytest.raises(ValueError, match="Unknown backend"):
        embedder("nope")
    register_embedder("Lengths", 1, lambda s: F.array(F.length(s).cast("float")))
    rows = spark.createDataFrame([("x", "MKV")], "seq_id string, sequence string")
    row = jobs.embed(rows, "lengths").first()
    assert (row["backend"], row["dim"], row["embedding"]) == ("Lengths", 1, [3.0])


def test_byte_histograms_of_slices():
    import numpy as np
    import pyarrow as pa

    from cohortlake.functions import sequence as module

    texts = ["ACCA", None, "", "é" * 50, "A" * 5000, "DD"] * 3
    column = pa.array(["skipped", *texts]).slice(1)
    rows = np.concatenate([module.byte_counts(p) for p in module.text_slices(column)])
    expected = [np.bincount(np.frombuffer((t or "").encode(), dtype=np.uint8), minlength=256) for t in texts]
    assert np.array_equal(rows, np.array(expected))
    module_bytes, module.HISTOGRAM_BYTES = module.HISTOGRAM_BYTES, 60
    try:
        parts = list(module.text_slices(column))
        assert len(parts) > 5 and sum(map(len, parts)) == len(texts)
        assert np.array_equal(np.concatenate([module.byte_counts(p) for p in parts]), np.array(expected))
    finally:
        module.HISTOGRAM_BYTES = module_bytes
    assert list(module.text_slices(pa.array([], pa.string()))) == []
