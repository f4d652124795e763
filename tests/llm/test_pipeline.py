import os

import duckdb
import pytest

import corpus_pipeline
from cohortlake.llm.decontamination import grams, share, words_of
from cohortlake.llm.near_dedup import near_duplicates
from cohortlake.llm.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not available")


def test_each_stage_on_all_its_predecessor_kept(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], FOLDER).write.parquet(f"{tmp_path}/{k}")
        kept.append(spark.read.parquet(f"{tmp_path}/{k}"))
    assert all(k.columns == columns for k in kept[:-1])
    rows = [{r.doc_id: r.text for r in k.collect()} for k in kept[:-1]]
    assert set(rows[1]) <= set(rows[0]) and set(rows[2]) <= set(rows[1]) and set(rows[3]) <= set(rows[2])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    good = [i for i in rows[0] if labels.get(i) == 1]
    assert sum(i in rows[1] for i in good) > 0.95 * len(good)
    wanted = {r.doc_id for r in near_duplicates(kept[1]).filter("kept").collect()}
    assert set(rows[2]) == wanted
    items = [grams(words_of(r.text)) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    leaks = {i for i, t in rows[2].items() if any(share(g, grams(words_of(t))) > 0.8 for g in items)}
    assert set(rows[2]) - set(rows[3]) == leaks
    assert kept[5].count() == kept[4].count()
    last = kept[5].orderBy("start").collect()
    assert all(a.start + a.n_tokens == b.start for a, b in zip(last, last[1:]))
    assert [r.doc_id for r in last] == sorted(r.doc_id for r in last)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    got = [tuple(r) for r in df.select(*sorted(df.columns)).collect()]
    assert got
    if name in ORACLE:
        duck = duckdb.connect()
        for t in ("documents", "embeddings", "pages"):
            duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
        result = duck.execute(ORACLE[name])
        names = [c[0] for c in result.description]
        assert sorted(names) == sorted(df.columns)
        assert sorted(got) == sorted(tuple(r[names.index(c)] for c in sorted(names)) for r in result.fetchall())


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).collect() == []
