import random

import numpy as np
from pyspark.sql import functions as F

from cohortlake.llm.decontamination import Index, find_leaks, grams, halves, share, words_of


def corpus():
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(3000)] + ["the", "of", "and"] * 300
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(8, 90))) + ".") for i in range(60)]
    items += [(60, None), (61, "too short"), (5, items[5][1]), (62, "What is it?\nthe answer is here now")]
    docs = []
    for i in range(150):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(5, 600))]
        if i % 3 == 0:
            leaked = rng.choice(items[:60])[1].split()
            if i % 2:
                leaked = [w if rng.random() > 0.08 else "changed" for w in leaked]
            at = rng.randrange(len(words))
            words[at:at] = leaked
        docs.append((i, " ".join(words)))
    docs += [(900, None), (901, ""), (None, items[7][1]), (902, "word " * 3000), (903, "What is it? Nobody knows."), (904, "What is it? The answer is HERE, now!")]
    return docs, items


def brute(docs, items):
    """Items of which a document holds most three-word grams, and those of which it holds few or none."""
    whole = [(i, grams(words_of(t or ""))) for i, t in items if len(words_of(t or "")) >= 5]
    for i, text in docs:
        own = grams(words_of(text or ""))
        shares = {n: share(g, own) for n, g in whole}
        yield i, {n for n, s in shares.items() if s > 0.7}, {n for n, s in shares.items() if s < 0.3}


def test_matches_brute_force(spark):
    docs, items = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit("clash")).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {r.doc_id: set(r["items"]) for r in find_leaks(df, bench).collect()}
    chunked = {r.doc_id: set(r["items"]) for r in find_leaks(df, bench, index_bytes=4000).collect()}
    assert len(found) == len(docs)
    for i, leaked, clean in brute(docs, items):
        assert leaked <= found[i] and not clean & found[i]
        assert leaked <= chunked[i] and not clean & chunked[i]
    assert found[904] == {62} and not found[903] and not found[902]


def test_wand_finds_all_above_the_threshold():
    _, items = corpus()
    index = Index.of([(i, t) for i, t in items if t], 5)
    rng = np.random.default_rng(3)
    dense = np.zeros((len(index.parts), len(index.terms)))
    for t, (which, weights) in enumerate(zip(index.posting_parts, index.posting_weights, strict=True)):
        dense[which, t] = weights
    assert np.allclose(dense.sum(axis=1), 1)
    for part in range(0, len(index.parts), 3):
        own = np.nonzero(dense[part])[0]
        query = np.unique(np.concatenate([rng.choice(own, max(1, int(len(own) * 0.7)), replace=False), rng.integers(0, len(index.terms), 30)]))
        wanted = set(np.nonzero(dense[:, query].sum(axis=1) >= 0.5)[0].tolist())
        got = {p for b in range(index.block_max.shape[1]) for p in index.wand(query, b, 0.5)}
        assert got == wanted


def test_question_and_answer():
    assert halves("What is the colour?\nIt is a deep blue", 3) == (["what", "is", "the", "colour"], ["it", "is", "a", "deep", "blue"])
    assert halves("one two three four five six", 3) == (["one", "two", "three", "four"], ["five", "six"])


def test_empty_tables_and_kept_columns(spark):
    docs = spark.createDataFrame([(1, "some text here")], "doc_id long, text string").withColumn("overlap", F.lit(1))
    bench = spark.createDataFrame([], "item_id long, text string")
    got = find_leaks(docs, bench, keep=docs.columns)
    assert got.columns == ["doc_id", "text", "overlap", "__items", "__overlap"] and got.first()["__items"] == []
    assert find_leaks(docs.limit(0), bench).collect() == []


def test_kept_rows_travel_with_one_copy_of_their_text(spark):
    docs, items = corpus()
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    kept = find_leaks(df, bench, keep=df.columns, index_bytes=4000)
    assert "__text" not in kept._jdf.queryExecution().executedPlan().toString()
    alone = find_leaks(df, bench).collect()
    assert sorted((r.doc_id or -1, r["__items"]) for r in kept.collect()) == sorted((r.doc_id or -1, r["items"]) for r in alone)
    binary = find_leaks(df.withColumn("text", F.col("text").cast("binary")), bench, keep=df.columns)
    assert sorted((r.doc_id or -1, r["__items"]) for r in binary.collect()) == sorted((r.doc_id or -1, r["items"]) for r in alone)
