"""Every query against its SQL on DuckDB."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as driver
from basepack.plans import queries as plans


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob("/root/testdata/sf0.001/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def rows(found, names):
    plain = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else v
    return sorted(repr([plain(v) for _, v in sorted(zip(names, r))]) for r in found)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_same_rows(spark, sf, duck, name):
    found = driver.queries()[name](spark, sf)
    expected = duck.sql(driver.oracle_sql()[name])
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows(map(tuple, found.collect()), found.columns) == rows(expected.fetchall(), expected.columns)


def test_entry(spark, sf):
    assert driver.entry(spark).count() > 0


def test_plans(spark, sf):
    """Window reads are equi-joins, and scans read the columns they need."""
    plan = driver.queries()["window_read_4bit"](spark, sf)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
