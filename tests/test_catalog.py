"""Every registered query of the language against its SQL in DuckDB."""

from __future__ import annotations

import datetime as dt
import decimal
import os

import duckdb
import pytest

from pipewright import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    return v.replace(tzinfo=None) if isinstance(v, dt.datetime) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted(([plain(r[k]) for k in order] for r in data), key=str)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    sql = catalog.oracle_sql().get(name)
    df = catalog.queries()[name](spark, DATA)
    mine = rows(df.columns, df.collect())
    if sql is None:
        assert mine[1]
        return
    got = duck.sql(sql)
    assert mine == rows(got.columns, got.fetchall())
