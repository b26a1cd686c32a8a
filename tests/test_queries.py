"""Every registered query beside its SQL in DuckDB, on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pytest

from pathloom import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for file in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def in_order(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def test_names_match():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    got = in_order(df.columns, [tuple(r) for r in df.collect()])
    if name not in catalog.ORACLES:
        assert got
        return
    rel = db.sql(catalog.ORACLES[name])
    want = in_order(list(rel.columns), rel.fetchall())
    assert sorted(df.columns) == sorted(rel.columns)
    assert repr(got) == repr(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns[:3] == ["SEQUENCE", "FIRSTFRAME", "LASTFRAME"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
