"""Every registered query against its SQL, values compared exactly."""

import math
import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as contract

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()
from tablewright.plans.oracles import ORACLES  # noqa: E402
from tablewright.plans.queries import QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def normal(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    return value


def sorted_rows(rows):
    return sorted((tuple(normal(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_sql(spark, duck, name):
    frame = QUERIES[name](spark, SF_DIR)
    columns = sorted(frame.columns)
    result = duck.sql(ORACLES[name])
    assert sorted(result.columns) == columns
    listed = ", ".join(f'"{c}"' for c in columns)
    expected = sorted_rows(duck.sql(f"SELECT {listed} FROM result").fetchall())
    actual = sorted_rows(frame.select(*columns).collect())
    assert len(actual) == len(expected)
    assert len(actual) > 0
    different = [(a, e) for a, e in zip(actual, expected) if a != e]
    assert not different, different[:3]
    for field in frame.select(*columns).schema.fields:
        kind = dict(zip(result.columns, result.types))[field.name]
        assert same_type(field.dataType.simpleString(), str(kind)), (field, kind)


def same_type(spark_type, duck_type):
    pairs = {
        "bigint": "BIGINT",
        "int": "INTEGER",
        "string": "VARCHAR",
        "double": "DOUBLE",
        "boolean": "BOOLEAN",
        "timestamp": "TIMESTAMP",
        "timestamp_ntz": "TIMESTAMP",
    }
    return pairs.get(spark_type) == duck_type
