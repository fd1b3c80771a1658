"""The driver contract: every query equals its SQL, with a stable schema."""

import re

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"
# Queries of the optional subpackage have tests of their own.
OWN = [n for n in queries() if not re.match(r"op\d+_|pipeline$", n)]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["conversation_id", "seq", "question", "answer"]
    assert df.count() > 0


def test_every_query_has_sql():
    assert set(OWN) <= set(oracle_sql())


@pytest.mark.parametrize("name", OWN)
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, name, SF) is None
