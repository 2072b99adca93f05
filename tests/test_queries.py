"""Every registered query against its SQL, on the smallest given tables."""

import os

import duckdb
import pandas as pd
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from locengine.plans.oracles import ORACLES
from locengine.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = [
    "nation", "events", "documents", "pages", "benchmark", "labels", "conversations",
]
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


def cell(value):
    if value is None or value is pd.NA or value is pd.NaT or value != value:
        return None
    if isinstance(value, str):
        return value
    return float(value)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    found = [tuple(map(cell, r)) for r in frame.itertuples(index=False)]
    return list(frame.columns), sorted(found, key=repr)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(queries()) and set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    ours = rows(QUERIES[name](spark, DATA).toPandas())
    theirs = rows(duck.sql(ORACLES[name]).df())
    assert ours[0] == theirs[0]
    assert len(ours[1]) == len(theirs[1]) > 0
    assert ours[1] == theirs[1]


def test_entry(spark):
    assert entry(spark).count() > 0
