"""Every query with SQL equals DuckDB on the smallest tables, in any partitioning; every query keeps its schema on empty tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.plans import catalogue
from tools_compare import plain

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_equals_sql(spark, con, name):
    df = catalogue.QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = con.execute(catalogue.SQL[name])
    theirs = [d[0] for d in cur.description]
    assert sorted(theirs) == cols
    assert got == sorted((tuple(plain(r[theirs.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["jaccard_block_join", "best_match_argmax", "latest_per_key", "as_of_join_validity", "set_new_gone_changed"])
def test_plans_have_no_nested_loops(spark, name):
    plan = catalogue.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
