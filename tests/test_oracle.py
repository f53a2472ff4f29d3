"""Every registered query against its DuckDB counterpart, and every query without one for a stable schema."""

import pytest

from textloom.plans import oracle, queries

QUERIES, SQL = queries.queries(), oracle.oracle_sql()


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(name, spark, data, duck, check_sql):
    check_sql(QUERIES[name](spark, data), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark, data):
    df = QUERIES[name](spark, data)
    assert df.columns and df.count() > 0


def test_entry(spark, data):
    import __spark_entry__ as E

    assert E.entry(spark).count() == 181
    assert set(E.oracle_sql()) <= set(E.queries())
