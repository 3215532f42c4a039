"""Every named query equals its SQL twin; the smallest tables have too few rows to meet every rounding edge."""

import pytest
from compare import compare, connect

from reelmill.plans.oracle import ORACLE as SQL
from reelmill.plans.registry import QUERIES

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_result(spark, con, name):
    assert compare(QUERIES[name](spark, FOLDER), con, SQL[name]) is None
