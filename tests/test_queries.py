"""Every reference query with SQL against DuckDB; the others run."""

import os

import duckdb
import pandas as pd
import pytest

from lamina.plans import registry

DATA = "/root/testdata/sf0.01"
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]

    def cell(v):
        if v is None or (not isinstance(v, (list, dict)) and pd.isna(v)):
            return "~"
        return f"{float(v):.6f}" if isinstance(v, float) else str(v)

    return sorted(tuple(map(cell, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    got, expect = registry.queries()[name](spark, DATA).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(expect.columns)
    assert rows(got) == rows(expect)


@pytest.mark.parametrize("name", sorted(registry.queries().keys() - SQL.keys()))
def test_runs(spark, name):
    assert registry.queries()[name](spark, DATA).count() > 0
