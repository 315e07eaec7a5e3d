"""Registered queries against their DuckDB oracle on the smallest tables, and entry()."""
import pytest

import __spark_entry__ as E
from newsgraph.plans.oracle import SQL
from newsgraph.plans.queries import QUERIES
from oracle_check import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    assert compare(spark, SF, name, E.queries()[name], E.oracle_sql().get(name), con, verbose=False)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(SQL)
    assert set(E.queries()) >= set(QUERIES) and set(E.oracle_sql()) >= set(SQL)


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert set(df.columns) >= {"article_id", "hallucination_flags", "fact_check_passed", "n_entities"}
