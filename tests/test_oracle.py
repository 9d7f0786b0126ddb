"""Every registered query against its SQL counterpart."""

import pytest
from compare import connect, duck_bag, spark_bag
from conftest import SMALL

from oracles.statements import all_statements
from shiftledger.plans.catalog import registered

QUERIES, STATEMENTS = registered(), all_statements()


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_every_query_has_a_statement():
    assert set(QUERIES) == set(STATEMENTS)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    columns, got = spark_bag(QUERIES[name](spark, SMALL))
    expected, want = duck_bag(con, STATEMENTS[name])
    assert columns == expected
    assert got == want
    assert got
