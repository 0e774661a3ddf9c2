"""Every registered query that has SQL, on the smallest tables."""

import pytest

from tests.oracle import compare, connect
from trendloom.plans import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, db, name):
    assert compare(spark, SF, name, db)[0] == "ok"


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
