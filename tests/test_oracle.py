"""Each registered query against its SQL in DuckDB."""

import os

import pytest

from checks import QUERIES, SQL
from checks.compare import compare, oracle

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def connection():
    return oracle(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, connection, name):
    assert compare(spark, connection, FOLDER, name) == ""


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)
