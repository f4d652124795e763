import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlake.llm.vector_search import Tree, exact_top_k


def brute(rows, every, k=5):
    good = [
        (i, [math.floor(256 * float(np.float32(x))) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for q, a in good:
        if q % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q and len(a) == len(b))
            out.extend((q, n, i, -s) for n, (s, i) in enumerate(scores[:k], 1))
    return sorted(out)


def cloud(seed, n, width=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, width))
    return [(i, (centres[i % 5] + rng.normal(scale=0.3, size=width)).tolist()) for i in range(n)]


@pytest.mark.parametrize("shard_rows", [40, 5000])
def test_matches_brute_force(spark, shard_rows):
    rows = cloud(1, 400)
    rows += [(400 + i, [0.5] * 6) for i in range(200)]  # a hot vector, split by identifiers
    rows += [(None, [1.0] * 6), (700, None), (750, [float("nan")] * 6), (800, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (850, [float("inf")] * 6)]
    rows += [(900, [1.0, 2.0]), (901, [2.0, 2.0]), (950, []), (1000, []), (1050, [3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("shard", F.lit("x")).repartition(3)
    got = sorted(tuple(r) for r in exact_top_k(df, every=50, shard_rows=shard_rows).collect())
    assert got == brute(rows, 50)


def test_few_candidates_and_empty_table(spark):
    df = spark.createDataFrame([(0, [1.0]), (3, [2.0]), (4, [-1.0])], "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in exact_top_k(df).collect())
    assert got == [(0, 1, 3, 256 * 512), (0, 2, 4, -256 * 256)]
    assert exact_top_k(df.limit(0)).collect() == []


def test_tree_with_large_values_is_exact():
    ids, vectors = np.arange(300), np.random.default_rng(3).integers(-(2**40), 2**40, (300, 3)).astype(object)
    tree = Tree(ids, vectors)
    for q in range(5):
        query = vectors[q]
        found = tree.search(query, tree.bounds(vectors[q : q + 1])[0], q, 4, (-float("inf"), 0))
        exact = sorted(((int(v @ query), -int(i)) for i, v in zip(ids, vectors) if i != q), reverse=True)[:4]
        assert found == exact
