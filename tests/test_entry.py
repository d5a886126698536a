"""The driver contract: every query runs, and agrees with its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from tallyline.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, float) and value == int(value):
        return str(int(value))
    return repr(value) if isinstance(value, float) else str(value)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, db, name):
    got = __spark_entry__.queries()[name](spark, SF)
    found = [tuple(r) for r in got.collect()]
    sql = __spark_entry__.oracle_sql().get(name)
    if sql is None:
        assert found
        return
    want = db.sql(sql)
    assert rows(got.columns, found) == rows(list(want.columns), want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1500
