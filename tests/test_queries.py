"""Every registered query against its SQL on the smallest tables."""

import glob

import duckdb
import pytest

import __spark_entry__ as entry_points

DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{DIR}/*.parquet"):
        db.execute(f"CREATE VIEW {path.split('/')[-1].split('.')[0]} AS SELECT * FROM '{path}'")
    return db


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(map(repr, frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    assert rows(QUERIES[name](spark, DIR).toPandas()) == rows(duck.sql(ORACLES[name]).df())


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
