"""Every registered query against its SQL in DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from netloom.plans import registry


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(frame, columns):
    cell = lambda v: f"{v:.5g}" if isinstance(v, float) else str(v)
    frame = frame[columns].astype(object)
    return sorted(tuple(map(cell, r)) for r in frame.where(frame.notna(), None).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(name, spark, sf, duck):
    got = registry.queries()[name](spark, sf).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert len(got)
        return
    want = duck.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))
