import pytest

from tidewright import catalog

from .oracle import connect, same


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_against_sql(spark, sf_dir, con, name):
    same(catalog.queries()[name](spark, sf_dir), con, catalog.oracle_sql()[name])


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
