"""The consolidation rule against SQL on random tables with nulls everywhere, and its corner cases."""

from __future__ import annotations

import random
from datetime import datetime

import duckdb
import pytest

from runlake import schemas
from runlake.operators import canonical, tabulate
from runlake.plans.views import T2_SQL


def table(spark, rows):
    return spark.createDataFrame([(loc, t, t, k, r) for loc, t, k, r in rows], schemas.T1)


def told(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", range(6))
def test_both_forms_agree_with_sql(spark, seed):
    rng = random.Random(seed)
    maybe = lambda x: None if rng.random() < 0.15 else x
    rows = [(maybe(rng.choice("AB")), maybe(datetime(2024, 1, 1, rng.randrange(3))), maybe(rng.randrange(3)), maybe(f"2024010{rng.randrange(1, 5)}T000000Z")) for _ in range(60)]
    con = duckdb.connect()
    con.execute("create table obs (location varchar, valid_time timestamp, analysis_time timestamp, kindex integer, run_id varchar)")
    con.executemany("insert into obs values (?, ?, ?, ?, ?)", [(a, b, b, c, d) for a, b, c, d in rows])
    want = sorted(con.execute(f"with {T2_SQL} select * from t2").fetchall(), key=str)
    df = table(spark, rows)
    assert told(canonical.build_t2(df)) == want
    assert told(canonical.build_t2_by_join(df)) == want


def test_latest_run_wins_even_with_null_or_two_values(spark):
    t = datetime(2024, 1, 1)
    df = table(spark, [("a", t, 3, "1"), ("a", t, None, "2"), ("b", t, 1, "1"), ("b", t, 2, "2"), ("b", t, 5, "2"), ("c", t, 4, "1"), ("c", t, 4, "1"), ("d", None, None, "9"), ("e", t, 1, None)])
    assert told(canonical.build_t2(df)) == [("a", t, None, False), ("b", t, 2, True), ("b", t, 5, True), ("c", t, 4, False)]
    assert told(canonical.duplicate_keys(canonical.build_t2(df))) == [("b", t, 2)]


def test_one_exchange_on_the_key(spark):
    df = table(spark, [("a", datetime(2024, 1, 1), 1, "1")])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = canonical.build_t2(df)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("Exchange hashpartitioning") == 1


def test_sentinels_of_both_plans(spark):
    runs = spark.createDataFrame([("1", "a", "SUCCESS"), ("2", "b", "SUCCESS"), ("3", "c", "FAILED")], schemas.MANIFEST)
    t = datetime(2024, 1, 1)
    obs = spark.createDataFrame([("1", t, t, 4), ("1", t, t, 4), ("3", t, t, 9), ("4", t, t, 9)], schemas.OBSERVATIONS)
    want = sorted([("a", t, t, 4, "1"), ("a", t, t, 4, "1"), ("b", None, None, None, "2")], key=str)
    assert told(tabulate.build_t1(runs, obs)) == told(tabulate.build_t1(runs, obs, n_runs=3)) == want
    assert [f.dataType for f in tabulate.build_t1(runs, obs, n_runs=3).schema] == [f.dataType for f in schemas.T1]
    assert tabulate.oldest(tabulate.unprocessed(runs, obs)).first().run_id == "2"
    assert tabulate.oldest(tabulate.unprocessed(runs.where("run_id = '1'"), obs)).first().run_id == ""


def test_a_hot_key_is_summed_before_each_shuffle(spark):
    rows = [("A", datetime(2024, 1, 1), k, f"2024010{k}T000000Z") for k in (1, 2, 3)] + [("B", datetime(2024, 1, 1), 7, "20240101T000000Z"), (None, None, 1, None)]
    out = canonical.consolidated(table(spark, rows))
    assert told(out) == [("A", datetime(2024, 1, 1), 3, True), ("B", datetime(2024, 1, 1), 7, False)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan
    assert told(canonical.consolidated(table(spark, []))) == []
    hot = spark.range(200_000, numPartitions=8).selectExpr("if(id % 3 = 0, 'hot', cast(id % 1000 as string)) location", "timestamp_ntz '2024-01-01 00:00:00' valid_time", "timestamp_ntz '2024-01-01 00:00:00' analysis_time", "cast(id % 7 as int) kindex", "cast(id % 5 as string) run_id")
    want = told(canonical.build_t2(hot))
    assert told(canonical.consolidated(hot)) == want and len(want) > 1000
    assert canonical.states(hot).where("location = 'hot'").count() == 1


@pytest.mark.parametrize("seed", range(4))
def test_states_merge_in_any_order(spark, seed):
    rng = random.Random(seed)
    maybe = lambda x: None if rng.random() < 0.15 else x
    rows = [(maybe(rng.choice("AB")), maybe(datetime(2024, 1, 1, rng.randrange(3))), maybe(rng.randrange(3)), maybe(str(rng.randrange(1, 6)))) for _ in range(80)]
    want = told(canonical.build_t2(table(spark, rows)))
    assert told(canonical.consolidated(table(spark, rows))) == want
    runs = sorted({r[3] for r in rows}, key=str)
    rng.shuffle(runs)
    held = None
    for run in runs:
        own = canonical.states(table(spark, [r for r in rows if r[3] == run]))
        held = own if held is None else canonical.merged(held.unionByName(own))
    assert told(canonical.told(held)) == want

