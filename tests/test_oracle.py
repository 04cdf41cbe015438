"""Every registered query against its SQL."""

import oracle
import pytest

from millrace import catalog

QUERIES = catalog.queries()
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, sf_dir, name):
    assert oracle.compare(spark, con, QUERIES[name], SQL[name], sf_dir) is None
