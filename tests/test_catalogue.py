"""Registered queries against their SQL on the smallest tables, where these are at hand."""

import datetime
import os

import duckdb
import pandas as pd
import pytest

from palisade.plans import catalogue, list_tables  # noqa: F401  list_tables adds to the catalogue
from palisade.sources.flat_files import TABLES, register_tables

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def cell(v):
    if v is None or v is pd.NA or v is pd.NaT or v != v:
        return ""
    if isinstance(v, (bool, str)):
        return str(v)
    if isinstance(v, (datetime.date, pd.Timestamp)):
        return str(v)[:19]
    return str(float(v))


def rows(df, columns):
    return sorted(tuple(map(cell, r)) for r in df[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    want = duck.execute(catalogue.ORACLE_SQL[name]).df()
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(want.columns)) == rows(want, sorted(want.columns))


def test_views(spark):
    register_tables(spark, SF)
    assert spark.sql("select count(*) as n from region").first().n > 0
