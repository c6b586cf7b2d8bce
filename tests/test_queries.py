"""Every query of the catalogue against its SQL, on the driver's smallest tables where they are there."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__
from runlake.plans import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables here")


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for table in ("events", "pages"):
        con.execute(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    want = con.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    want = sorted(map(repr, want.fetchall()))
    got = catalogue.queries()[name](spark, DATA)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(repr(tuple(r)) for r in got.select(*columns).collect()) == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalogue.queries()["latest_run_per_key"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string>" in plan
