"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

import pytest

from tests.oracle import connect, same
from tidemark import plans

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_oracle(spark, con, name):
    same(con, plans.queries()[name](spark, FOLDER), plans.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_runs(spark, name):
    assert plans.queries()[name](spark, FOLDER).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
