"""Every registered query next to its SQL in DuckDB, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from check_oracles import compare, connect

from conftest import SF_DIR

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_names():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 100


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["record_id", "cluster_id"] and rows.count() == 201


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    assert compare(spark, duck, SF_DIR, QUERIES[name], ORACLES.get(name)) is None
