"""Every query with SQL gives the rows of that SQL, at the smallest scale."""

import pytest

from quarrylight.plans import catalogue, harness

SMALL = "/root/testdata/sf0.001"
SQL = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return harness.duck(SMALL)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(catalogue.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_the_rows_of_its_sql(spark, con, name):
    assert harness.compare(catalogue.queries()[name](spark, SMALL), con, SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalogue.queries()[name](spark, SMALL).count() >= 0
