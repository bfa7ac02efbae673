"""Every registered query against its SQL twin in DuckDB, at the smallest scale."""

import math
from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import entry
from workload.registry import QUERIES
from workload.sql import ORACLE

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for file in Path(SF).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in rows)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    result = db.execute(ORACLE[name])
    want = table([c[0] for c in result.description], result.fetchall())
    assert table(df.columns, df.collect()) == want


def test_entry(spark):
    assert entry(spark).count() > 0
