"""Every registered query against its SQL, and what its plan must not hold."""

import time

import pytest

import __spark_entry__ as driver
from pageloom import queries as registered
from pageloom.queries.compare import differences, duckdb_views

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registered.QUERIES, registered.SQL


@pytest.fixture(scope="module")
def db():
    return duckdb_views(SF)


def test_all_have_sql():
    assert set(SQL) == set(QUERIES)
    assert set(QUERIES) <= set(driver.queries()) and set(SQL) <= set(driver.oracle_sql())


def test_entry(spark):
    assert driver.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    assert differences(df, db, SQL[name]) == []
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_under_a_limit(db, name):
    """A planner may fold a limit into the statement: it has to end all the same."""
    start = time.time()
    db.execute(f"SELECT count(*) FROM (SELECT * FROM ({SQL[name]}) LIMIT 200000)").fetchone()
    assert time.time() - start < 20
