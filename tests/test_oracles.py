"""Every query with SQL gives the SQL's rows on the smallest tables; every other gives rows."""

import os

import pytest

from filigree.plans.catalogue import ORACLES, QUERIES

from .compare import connect, difference

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connection, name):
    df = QUERIES[name](spark, SF_DIR)
    if name in ORACLES:
        assert difference(df, connection, ORACLES[name]) == ""
    else:
        assert df.count() > 0
