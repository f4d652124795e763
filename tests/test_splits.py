import hashlib

import pytest
from pyspark.sql import functions as F

from cohortlake.operators import labels, splits
from cohortlake.operators.ranking import sample_per_class, stratum_rank


def key(seed, ident):
    return hashlib.md5(f"{seed}:{ident}".encode()).hexdigest()


def skewed(spark, n=3000):
    """One class holds most of the rows."""
    rows = [(i, "hot" if i % 10 else [None, "c1", "c2"][i % 3]) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id int, label string").repartition(6)


def test_stratum_rank_is_a_plain_row_number(spark):
    rows, df = skewed(spark)
    got = {r["id"]: (r["rank"], r["stratum_size"]) for r in stratum_rank(df, ["label"], "id", 7).collect()}
    for label in {x for _, x in rows}:
        ordered = sorted((i for i, x in rows if x == label), key=lambda i: key(7, i))
        assert [got[i] for i in ordered] == [(k + 1, len(ordered)) for k in range(len(ordered))]


def test_sample_per_class(spark):
    rows, df = skewed(spark)
    got = {}
    for r in sample_per_class(df, "label", "id", 25, 3).collect():
        got.setdefault(r["label"], set()).add(r["id"])
    for label, ids in got.items():
        assert ids == set(sorted((i for i, x in rows if x == label), key=lambda i: key(3, i))[:25])
    assert sample_per_class(df, "label", "id", 0, 3).count() == sample_per_class(df, "label", "id", None, 3).count() == 3000


@pytest.mark.parametrize("sizes, test_size, expected", [([720, 720], 0.25, (1080, 360)), ([120, 120], 0.2, (192, 48)), ([5, 4, 4], 0.25, (9, 4))])
def test_stratified_split_sizes(spark, sizes, test_size, expected):
    rows = [(f"{c}-{i}", c) for c, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(rows, "id string, label int")
    parts = {r["part"]: r["count"] for r in splits.stratified_split(df, "label", "id", test_size).groupBy("part").count().collect()}
    assert (parts["train"], parts["test"]) == expected


def test_small_or_single_class_stays_in_training(spark):
    for rows in ([("a", 0), ("b", 1), ("c", 1)], [(str(i), 0) for i in range(20)]):
        df = spark.createDataFrame(rows, "id string, label int")
        assert {r["part"] for r in splits.stratified_split(df, "label", "id").collect()} == {"train"}


@pytest.mark.parametrize("n, fraction, expected", [(300, 0.8, 240), (1, 0.8, 1), (5, 0.5, 2), (7, 0.5, 4)])
def test_fraction_rounds_half_to_even(spark, n, fraction, expected):
    df = spark.range(n).selectExpr("id", "'x' as label")
    assert splits.stratified_fraction(df, "label", "id", fraction).filter("part = 'train'").count() == expected


def test_group_folds(spark):
    rows = [(f"g{i % 60}" if i % 3 else "hot", "ab"[(i // 7) % 2], i) for i in range(1500)]
    df = spark.createDataFrame(rows, "grp string, label string, id int")
    folded = splits.with_group_fold(df, "label", "grp", 4)
    per_group = folded.groupBy("grp").agg(F.count_distinct("fold").alias("n")).collect()
    assert all(r["n"] == 1 for r in per_group) and folded.count() == 1500
    dealt = {r["fold"]: r["count"] for r in splits.group_folds(df, "label", "grp", 4).groupBy("fold").count().collect()}
    assert sum(dealt.values()) == len(per_group) and max(dealt.values()) - min(dealt.values()) <= 2
    again = splits.group_folds(df.repartition(3), "label", "grp", 4)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, splits.group_folds(df, "label", "grp", 4).collect()))


@pytest.mark.parametrize("desired, expected", [(5, 3), (2, 2), (1, 2), (3, 3)])
def test_fold_count(spark, desired, expected):
    df = spark.createDataFrame([(f"g{i}", "a" if i < 3 else "b") for i in range(9)], "grp string, label string")
    assert splits.fold_count(df, "label", "grp", desired).first()["folds"] == expected


def test_labels(spark):
    df = spark.createDataFrame([("s1",), ("s2",), ("s3",)], "seq_id string")
    table = spark.createDataFrame([("s1", "x", 0), ("s1", "y", 1), ("s3", "x", 2)], "seq_id string, label string, at int")
    once = labels.last_per_id(table, "seq_id", "label", "at")
    joined = {r["seq_id"]: r["label"] for r in labels.attach_labels(df, once, "seq_id").collect()}
    assert joined == {"s1": "y", "s2": None, "s3": "x"}
    assert [r[0] for r in labels.unlabelled(df, once, "seq_id").collect()] == ["s2"]
    with pytest.raises(ValueError, match=r"no label for 1 of the seq_id values, the first being \['s2'\]"):
        labels.require_labels(df, once, "seq_id")
    labels.require_labels(df.filter("seq_id <> 's2'"), once, "seq_id")
    weights = {r["label"]: r["weight"] for r in labels.class_weights(once, "label").collect()}
    assert weights == {"x": 1.0, "y": 1.0}
    encoded = {r["label"]: r["label_index"] for r in labels.encode_labels(table, "label").collect()}
    assert encoded == {"x": 0, "y": 1}


def test_rows_without_label_or_group_stay(spark):
    rows = [(f"s{i}", ("a", "b", None)[i % 3], None if i % 4 == 0 else f"g{i % 5}") for i in range(60)]
    df = spark.createDataFrame(rows, "sample_id string, label string, group_id string")
    parts = splits.stratified_split(df, "label", "sample_id")
    assert {(r["label"], r["part"]): r["count"] for r in parts.groupBy("label", "part").count().collect()} == {
        (label, part): n for label in ("a", "b", None) for part, n in (("train", 15), ("test", 5))
    }
    folds = splits.with_group_fold(df, "label", "group_id", 3)
    assert folds.count() == 60 and folds.filter("group_id is null").select("fold").distinct().count() == 1
    assert folds.columns == ["sample_id", "label", "group_id", "fold"]


def worst_share(df, dealt, folds):
    """The greatest distance of a fold's part of a class from the ideal one."""
    joined = df.join(dealt.withColumnRenamed("grp", "g"), F.col("grp").eqNullSafe(F.col("g")))
    cells = {(r["fold"], r["label"]): r["count"] for r in joined.groupBy("fold", "label").count().collect()}
    totals = {r["label"]: r["count"] for r in df.groupBy("label").count().collect()}
    return max(abs(cells.get((f, c), 0) / n - 1 / folds) for f in range(folds) for c, n in totals.items())


def test_balanced_group_folds(spark):
    # Every fourth group by size holds class c: round robin deals all of them to one fold.
    rows = [(f"g{g:03d}", "ab"[i % 5 == 0]) for g in range(40) for i in range(10 * (40 - g))]
    rows += [(f"g{g:03d}", "c") for g in range(0, 40, 4) for _ in range(9)] + [(f"s{i}", "ac"[i % 2]) for i in range(100)]
    rows += [(None, "a")] * 30 + [("g001", None)] * 4 + [("g002", None)] * 4 + [("g003", None)] * 4 + [("g005", None)] * 4
    df = spark.createDataFrame(rows, "grp string, label string")
    dealt = splits.balanced_group_folds(df, "label", "grp", 4, share=0.02)
    assert dealt.count() == dealt.distinct().count() == df.select("grp").distinct().count()
    round_robin = splits.group_folds(df, "label", "grp", 4)
    assert worst_share(df, dealt, 4) < 0.03 < 0.1 < worst_share(df, round_robin, 4)
    again = splits.balanced_group_folds(df.repartition(5), "label", "grp", 4, share=0.02)
    assert set(map(tuple, again.collect())) == set(map(tuple, dealt.collect()))
    every = splits.balanced_group_folds(df, "label", "grp", 4, share=1e-9)  # all groups one by one
    assert worst_share(df, every, 4) < 0.03
    none = splits.balanced_group_folds(df, "label", "grp", 4, share=100.0)  # all dealt in turn
    assert set(map(tuple, none.collect())) == set(map(tuple, round_robin.collect()))
    assert splits.balanced_group_folds(df.limit(0), "label", "grp", 4).count() == 0
