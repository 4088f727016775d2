"""Every store query against its SQL, by DuckDB, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from lamina.plans.store_queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, duck, name):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda df: sorted(map(tuple, df[columns].astype(str).values.tolist()))
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(ORACLE_SQL) == set(QUERIES) and set(QUERIES) <= set(entry.queries())


def test_pushdown(spark, sf):
    """Predicates reach the scan, and only the columns asked for are read."""
    plan = QUERIES["and_preds"](spark, sf)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(o_orderkey)" in plan.replace("PushedFilters: [IsNotNull(o_totalprice), IsNotNull(o_orderkey)", "PushedFilters: [IsNotNull(o_orderkey)")
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan and "Exchange" not in plan.split("== Physical Plan ==")[1]
