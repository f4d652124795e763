import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlake.llm import components
from cohortlake.llm.components import connect
from cohortlake.llm.near_dedup import BANDS, _probes, band_keys, near_duplicates, outline
from cohortlake.llm.shingles import words_of


def shingles(text, width):
    words = words_of((text or "").encode())
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute(rows, width):
    """Component of each row over all pairs of rows."""
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        common = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
            parent[find(a)] = find(b)
    least = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            least[find(n)] = min(i, least.get(find(n), i))
    return sorted(((i, len(s), least.get(find(n), i)) for n, ((i, _), s) in enumerate(zip(rows, sets))), key=str)


def corpus():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "single"), (1004, "SINGLE"), (1005, "two words"), (1006, "two  WORDS")]
    number = 0
    for _ in range(25):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 30, 120]))]
        for _ in range(rng.choice([1, 3, 12])):
            copy = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 12))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((number, " ".join(copy)))
            number += 1
    rows += [(2000, "the same short text here"), (2000, "a different text, same number"), (2001, "the same short text here")]
    rows += [(None, "a nameless text of some words"), (3, "x " * 5000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("width", [2, 5])
def test_components_match_brute_force(spark, width):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("clash")).repartition(4)
    found = near_duplicates(df, width=width).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str) == brute(rows, width)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_survivors(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__row", F.lit(1)).repartition(3)
    df = df.withColumnRenamed("__row", "extra")
    kept = near_duplicates(df, width=5, survivors=True)
    assert kept.columns == df.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    wanted = [i for i, n, c in brute(rows, 5) if n and (i == c)]
    empties = [i for i, n, _ in brute(rows, 5) if not n]
    # 2000 stands for two groups, of which each keeps one row.
    assert ids == sorted(wanted + empties, key=str)


def test_pairs_outside_the_centres_of_large_buckets(spark):
    template = [f"t{k}" for k in range(137)]
    # Close copies of the template, a little below 0.8 to all others, are the best connected sets.
    rows = [(1000 + n, " ".join(template + [f"c{k}" for k in range(16)] + [f"n{n}"])) for n in range(60)]
    for pair in range(100):
        shared = [*template, f"p{pair}"]
        for twin in (2 * pair, 2 * pair + 1):
            rows.append((twin, " ".join(shared + [f"o{twin}_{k}" for k in range(17)])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = near_duplicates(df, width=1).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str) == brute(rows, 1)
    assert {r.component_id for r in found} == {1000, *range(0, 200, 2)}


def test_near_copy_without_identifier(spark):
    words = [f"w{k}" for k in range(60)]
    rows = [(7, " ".join(words)), (None, " ".join([*words, "more"])), (None, "another text")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = near_duplicates(df, width=2).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str) == brute(rows, 2)
    kept = near_duplicates(df, width=2, survivors=True).collect()
    assert sorted(r.text for r in kept) == sorted([rows[0][1], rows[2][1]])


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(df).collect() == [] and near_duplicates(df, survivors=True).collect() == []


def test_slots_agree_as_often_as_sets_are_similar():
    rng, probes = np.random.default_rng(1), _probes()
    for size, common in ((5, 4), (40, 36), (500, 450)):
        hits = []
        for _ in range(200):
            values = rng.integers(0, 2**63, 2 * size - common, dtype=np.uint64)
            a, b = np.unique(values[:size]), np.unique(values[size - common :])
            hits.append((band_keys(a, probes) == band_keys(b, probes)).mean())
        similarity = common / (2 * size - common)
        assert abs(np.mean(hits) - similarity**4) < 0.06
        assert min(hits) * BANDS >= 1 or size == 5


def test_connect(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(500 + i, 501 + i) for i in range(60)] + [(7, 7)]
    df = spark.createDataFrame(edges, "a int, b int")
    half = connect(df.filter("a % 2 = 0"))
    got = {r.node: r.component for r in connect(df, half).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    assert got == {x: find(x) for x in list(parent)}
    assert connect(df.limit(0)).collect() == []


def test_only_large_hubs_are_broadcast(spark, monkeypatch):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        # Two stars, of which the larger one hangs on a path, and single links.
        links = [(0, n) for n in range(1, 300)] + [(400, n) for n in range(401, 450)] + [(299 + n, 300 + n) for n in range(20)]
        links += [(n, n + 1) for n in range(1000, 1100, 2)]
        df = spark.createDataFrame([(max(e), min(e)) for e in links], "a long, b long").repartition(4)

        def step():
            made = components._large(df, len(links))
            found = sorted(tuple(r) for r in made.collect())  # the adaptive plan is final after that
            return found, "BroadcastHashJoin" in made._jdf.queryExecution().executedPlan().toString()

        plain, broadcast = step()
        assert not broadcast
        whole = sorted(tuple(r) for r in connect(df).collect())
        monkeypatch.setattr(components, "HOT_ROWS", 100)
        hub, broadcast = step()
        assert broadcast and hub == plain
        assert sorted(tuple(r) for r in connect(df).collect()) == whole
        monkeypatch.setattr(components, "HOT_ROWS", 500)  # more rows in all, but in no key
        assert step() == (plain, False)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_outlines_never_exclude_a_link():
    rng = np.random.default_rng(3)
    for _ in range(200):
        both = rng.integers(0, 2**63, rng.integers(1, 400)).astype(np.uint64)
        a, b = (np.unique(np.r_[both, rng.integers(0, 2**63, rng.integers(0, 100)).astype(np.uint64)]) for _ in range(2))
        bound = np.minimum(*(np.frombuffer(outline(s), dtype=np.int32) for s in (a, b))).sum()
        assert bound >= len(np.intersect1d(a, b))


def test_few_links_take_one_shuffle_a_star(spark):
    df = spark.createDataFrame([(b, a) for a, b in [(1, 2), (2, 3), (3, 9), (5, 6), (6, 9), (7, 8)]], "a long, b long")
    star = components._small(components._large(df, 6), 6)
    plan = star._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan
    assert {r.node: r.component for r in connect(df).collect()} == {1: 1, 2: 1, 3: 1, 9: 1, 5: 1, 6: 1, 7: 7, 8: 7}
