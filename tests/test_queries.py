"""Every registered query against its SQL, on the smallest data folder."""

import os
from pathlib import Path

import pytest

import __spark_entry__ as entry
from shelfwise.checks import ORACLES, QUERIES

duckdb = pytest.importorskip("duckdb")
FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for path in sorted(Path(FOLDER).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def plain(value):
    """Values of both engines in one comparable form."""
    if value is None or isinstance(value, (bool, str)):
        return repr(value)
    if isinstance(value, int):
        return str(value)
    return f"{float(value):.9g}"


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_agrees_with_sql(spark, database, name):
    got = QUERIES[name](spark, FOLDER)
    wanted = database.execute(ORACLES[name])
    columns = [c[0] for c in wanted.description]
    assert sorted(got.columns) == sorted(columns)
    assert table(got.columns, got.collect()) == table(columns, wanted.fetchall())


def test_flagship_query(spark):
    df = entry.entry(spark)
    assert df.columns == ["release_date", "developer", "score"] and df.count() > 0
