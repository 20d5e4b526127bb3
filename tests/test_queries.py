"""Every registered query with reference SQL against a second engine."""

import math
import os

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries
from groundline.plans.inputs import GIVEN

DATA = "/root/testdata/sf0.001"
FAST = sorted(oracle_sql())


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return None if value is None else str(value)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in GIVEN:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    return connection


@pytest.mark.skipif(not os.path.isdir(DATA), reason="given tables are not here")
@pytest.mark.parametrize("name", FAST)
def test_query_equals_reference_sql(spark, duck, name):
    frame = queries()[name](spark, DATA)
    columns = sorted(frame.columns)
    result = duck.execute(oracle_sql()[name])
    names = [column[0] for column in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(row[names.index(c)]) for c in columns) for row in result.fetchall()), key=str)
    got = sorted((tuple(plain(row[c]) for c in columns) for row in frame.collect()), key=str)
    assert got == want
