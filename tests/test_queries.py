import pytest

from __spark_entry__ import entry, oracle_sql, queries
from spanveil.plans.queries import QUERIES
from compare import connect, difference


@pytest.fixture(scope="module")
def db(sf):
    return connect(sf)


def test_every_query_has_sql():
    assert set(QUERIES) <= set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, sf, db, name):
    assert difference(spark, db, sf, queries()[name], oracle_sql()[name]) is None


def test_entry(spark):
    assert entry(spark).count() == 200
