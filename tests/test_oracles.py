"""Registered queries against their SQL twins on the smallest tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from ionloom.plans import catalogue

FOLDER = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    def text(value):
        if pd.isna(value):
            return "null"
        return f"{value:.5f}" if isinstance(value, float) else str(value)

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(text(v) for v in r) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


@pytest.mark.skipif(not FOLDER.exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, database, name):
    found = entry.queries()[name](spark, str(FOLDER)).toPandas()
    expected = database.execute(entry.oracle_sql()[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows(found) == rows(expected)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
