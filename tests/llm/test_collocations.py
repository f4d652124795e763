import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlake.llm import collocations as module
from cohortlake.llm.collocations import Filter, built, collocations

SCHEMA = "lang string, text string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10, longest=3, top=2000, covered=50):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            own = counts.setdefault(lang, Counter())
            for size in range(1, longest + 1):
                own.update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, f in counts.items():
        cand = [p for p, a in f.items() if len(p) > 1 and a >= least]
        longer = Counter()
        for p in cand:
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longer[p[i : i + m]] = max(longer[p[i : i + m]], f[p])
        ranked = []
        for p in cand:
            if 100 * longer[p] >= covered * f[p] and longer[p]:
                continue
            score, k = min((1_000_000 * f[p] ** 2 // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            ranked.append((-score, -f[p], " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -s))
    return sorted(out)


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["the", "of", "New", "york", "city", "ŒUVRE", "œuvre", "a", "x" * 300, "l'été", "日本"]
    seps = [" ", "  ", "\t", ", ", "\n", ". ", "\r\n", " \x0b", "  "]
    rows = []
    for _ in range(n):
        text = "".join(rng.choice(words) + rng.choice(seps) for _ in range(rng.randint(0, 40)))
        rows.append((rng.choice(["en", "en", "en", "fr", None]), text + "new york city " * rng.randint(0, 2)))
    return rows


def collected(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("shards", [1, 4])
def test_matches_brute_force(spark, shards):
    rows = corpus(shards, 150)
    rows += [("en", None), ("en", ""), (None, None), ("de", "..."), ("fr", "\n\n")]
    rows += [("en", "copied words here, ")] * 12  # repeated rows count each time
    rows += [("es", "hola mundo " * 4000)]  # overlaps, and a language of one long text
    df = spark.createDataFrame(rows, SCHEMA).withColumn("phrase", F.lit(1)).withColumn("f", F.lit(2)).repartition(5)
    assert collected(collocations(df, shards=shards)) == brute(rows)
    assert collected(collocations(df, shards=shards, least=4, top=7, longest=2)) == brute(rows, 4, 2, 7)


def test_small_buffers_change_nothing(spark, monkeypatch):
    rows = corpus(9, 120)
    monkeypatch.setattr(module, "HELD", 16)
    monkeypatch.setattr(module, "SLICE", 100)
    monkeypatch.setattr(module, "KNOWN_WORDS", 64)
    monkeypatch.setattr(module, "MOST_BITS", 1 << 10)
    monkeypatch.setattr(module, "HOT_PARTS", 4)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert collected(collocations(df, least=5)) == brute(rows, 5)


def test_empty_table_and_ties(spark):
    assert collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [("en", "b c. a b. c d")] * 10  # equal scores and counts of two: by phrase
    got = collocations(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r["rank"], r["phrase"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, "a b"), (2, "c d"), (3, "b c")]
    assert collected(collocations(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_large_counts_stay_exact(spark):
    a, left, right = 40_000_000_019, 99_999_999_977, 88_888_888_889
    df = spark.createDataFrame([(a, left, right)], "a long, l long, r long")
    got = df.select(module.cut_scores(F.col("a"), F.col("l"), F.col("r"))).first()[0]
    assert got == 1_000_000 * a * a // (left * right)


def test_filter_never_misses(spark):
    hashes = spark.range(5000).select(F.xxhash64("id").alias("h"))
    filter_ = built(hashes)
    import numpy as np

    values = np.array([r["h"] for r in hashes.collect()], dtype=np.int64).view(np.uint64)
    assert isinstance(filter_, Filter) and filter_.holds(values).all()
    assert filter_.holds(module.mix(np.arange(5000, dtype=np.uint64))).mean() < 0.1


def test_tally_holds_little_more_than_its_phrases(monkeypatch):
    monkeypatch.setattr(module, "HELD", 1 << 18)
    rng = np.random.default_rng(7)
    keys = [rng.integers(0, 1 << 20, 1 << 14) for _ in range(30)]
    tally, found = module.Tally(lambda *pair: pair), Counter()
    tracemalloc.start()
    try:
        for part in keys:
            for pair in tally.add(part):
                found.update(dict(zip(*(x.tolist() for x in pair), strict=True)))
                tracemalloc.clear_traces()
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    for pair in tally.flush():
        found.update(dict(zip(*(x.tolist() for x in pair), strict=True)))
    assert found == Counter(np.concatenate(keys).tolist())
    assert peak < 40 * module.HELD  # 16 bytes a phrase, and one of the two arrays again


def test_rare_words_take_no_number(spark):
    rows = [("en", f"rare{i} new york city rare{i}x") for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA).select("lang", F.col("text").cast("binary").alias("text"))
    words = spark.createDataFrame([(hash_,) for hash_ in hashes_of("en", ["new", "york", "city"])], "h long")
    everything = Filter(np.full((16, 64), 255, dtype=np.uint8))
    got = collected(module.exact_counts(df, {1: built(words), 2: everything, 3: everything}, 3, 1))
    assert got == [
        ("en", "city", 1, 40),
        ("en", "new", 1, 40),
        ("en", "new york", 2, 40),
        ("en", "new york city", 3, 40),
        ("en", "york", 1, 40),
        ("en", "york city", 2, 40),
    ]


def hashes_of(lang, words):
    return [int(h) for h in module.Phrases(lang, " ".join(words).encode()).words.view(np.int64)]
