"""Every registered query against its SQL on the smallest tables, and plan rules for all of them."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from cohortlake.plans.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not available")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    yield connection
    connection.close()


def comparable(rows):
    def cell(v):
        return None if v is None or (isinstance(v, float) and math.isnan(v)) else v

    return sorted((tuple(map(cell, r)) for r in rows), key=lambda r: tuple((v is None, v if v is not None else 0) for v in r))


def assert_scalable(df):
    """No pairwise product of two tables anywhere in the plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    assert_scalable(df)
    columns = sorted(df.columns)
    result = duck.execute(ORACLE[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    expected = [tuple(r[names.index(c)] for c in columns) for r in result.fetchall()]
    got = [tuple(r) for r in df.select(*columns).collect()]
    assert len(got) > 0
    assert comparable(got) == comparable(expected)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_fitted_query_runs(spark, name):
    df = QUERIES[name](spark, FOLDER)
    assert_scalable(df)
    assert df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["label", "precision", "recall", "f1", "support"]


def test_entry_offers_every_query():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())
