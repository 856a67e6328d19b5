"""Every registered query with SQL gives the SQL's rows (DuckDB, smallest tables)."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from corvane.queries import ORACLE, QUERIES
from tests.conftest import DATA


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return c


def rows(names, values):
    at = sorted(range(len(names)), key=lambda i: names[i])
    show = lambda v: round(v, 9) if isinstance(v, float) else v
    return [names[i] for i in at], sorted(repr([show(r[i]) for i in at]) for r in values)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = duck.execute(ORACLE[name])
    assert rows(df.columns, df.collect()) == rows([d[0] for d in got.description], got.fetchall())


def test_registry():
    assert set(ORACLE) <= set(QUERIES) and set(QUERIES) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_filters_reach_the_scan(spark):
    plan = QUERIES["client_performance"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan and "o_orderstatus" not in plan
