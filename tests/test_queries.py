"""Every registered query against its SQL; queries without SQL must run and keep their keys."""

import pytest
from compare import differences, oracle_connection

import __spark_entry__ as entry_module

QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con(folder):
    return oracle_connection(folder)


def test_every_statement_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, folder, con, name):
    ours = QUERIES[name](spark, folder).toPandas()
    assert differences(ours, con.execute(ORACLES[name]).df()) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_run(spark, folder, name):
    rows = QUERIES[name](spark, folder).toPandas()
    assert len(rows)
    if "score" in rows:
        assert rows["score"].between(0, 2).all()


def test_entry(spark):
    kept = entry_module.entry(spark)
    assert 0 < kept.count() < 1000
