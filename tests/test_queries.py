"""Every registered query against its SQL form on the smallest driver tables."""

import os
from collections import Counter

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from workload.bindings import TABLES

SF = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


def plain(value):
    return round(value, 9) if isinstance(value, float) else value


@pytest.mark.parametrize("name", list(oracle_sql()))
def test_query(spark, duck, name):
    got = queries()[name](spark, SF)
    result = duck.execute(oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(got.columns)
    expected = Counter(tuple(plain(v) for v in row) for row in result.fetchall())
    actual = Counter(tuple(plain(v) for v in row) for row in got.select(*columns).collect())
    assert actual == expected


def test_entry(spark):
    assert entry(spark).columns[:2] == ["change_set_id", "priority"]
