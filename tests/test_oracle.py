"""Every registered query over the star-schema tables against its SQL in DuckDB."""

import pytest

from spacemill.plans import registry
from tests import compare

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return compare.duck(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf, con, name):
    assert compare.differences(QUERIES[name](spark, sf), con, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
