from __future__ import annotations

from datetime import UTC, datetime, timedelta, timezone

import pytest

from runlake.functions import timefmt

FMT = "%Y-%m-%d %H:%M:%S"


def test_api_text_keeps_what_fits_and_moves_zones():
    assert timefmt.api_text(None, FMT) is None
    assert timefmt.api_text("2024-01-02 03:04:05", FMT) == "2024-01-02 03:04:05"
    assert timefmt.api_text(datetime(2024, 1, 2, 3, 4, 5), FMT) == "2024-01-02 03:04:05"
    assert timefmt.api_text(datetime(2024, 1, 2, 3, tzinfo=timezone(timedelta(hours=10))), FMT) == "2024-01-01 17:00:00"


@pytest.mark.parametrize("bad", ["", "2024-01-02T03:04:05", "2024-01-02 03:04:05+10:00", "yesterday"])
def test_text_must_fit_exactly(bad):
    with pytest.raises(ValueError):
        timefmt.api_text(bad, FMT)
    with pytest.raises(ValueError):
        timefmt.parse(bad, FMT)


@pytest.mark.parametrize("bad", [7, 7.5, ["2024"], None])
def test_other_types_are_refused(bad):
    with pytest.raises(TypeError):
        timefmt.parse(bad, FMT)


def test_ids_tokens_and_local_text():
    clock = lambda: datetime(2024, 7, 1, 12, 0, 9, 999_999, UTC)
    assert timefmt.new_run_id(clock) == "20240701T120009Z"
    assert timefmt.token(None) == "open"
    assert timefmt.token(datetime(2024, 1, 1, 10, tzinfo=timezone(timedelta(hours=10)))) == "20240101T000000Z"
    assert timefmt.local_text(None, FMT) is None
    assert timefmt.local_text("2024-07-01 00:00:00", FMT) == "2024-07-01 10:00:00 AEST"
    assert timefmt.local_text("2024-01-01 00:00:00", FMT) == "2024-01-01 11:00:00 AEDT"


def test_steps_cover_the_range_once():
    a, b = datetime(2024, 1, 1), datetime(2024, 1, 6)
    parts = timefmt.steps(a, b, 2)
    assert parts[0][0] == a and parts[-1][1] == b
    assert all(x[1] == y[0] for x, y in zip(parts, parts[1:], strict=False))
    assert [y - x for x, y in parts] == [timedelta(2), timedelta(2), timedelta(1)]
    assert timefmt.steps(a, a, 2) == [(a, a)]


def test_column_forms_agree_with_the_driver_ones(spark):
    from pyspark.sql import functions as F

    t = datetime(2024, 1, 31, 23, 59, 59)
    row = spark.createDataFrame([(t, t + timedelta(days=5))], "a timestamp_ntz, b timestamp_ntz").select(timefmt.token_column(F.col("a")).alias("token"), timefmt.token_column(F.lit(None).cast("timestamp_ntz")).alias("open"), timefmt.text_column(F.col("a")).alias("text"), timefmt.text_column(timefmt.local_column(F.col("a"))).alias("local"), timefmt.steps_column(F.col("a"), F.col("b"), 2).alias("steps"), timefmt.steps_column(F.col("a"), F.col("a"), 2).alias("one")).first()
    assert row.token == timefmt.token(t) and row.open == "open" and row.text == "2024-01-31 23:59:59"
    assert row.local == timefmt.local_text(row.text, FMT).rsplit(" ", 1)[0]
    assert [tuple(s) for s in row.steps] == timefmt.steps(t, t + timedelta(days=5), 2)
    assert [tuple(s) for s in row.one] == [(t, t)]


def test_zone_names_around_every_change(spark):
    from zoneinfo import ZoneInfo

    changes = timefmt.zone_changes(first=1990, last=2030)
    assert len(changes) > 75 and {name for _, name in changes} == {"AEST", "AEDT"}
    times = [at + timedelta(seconds=s) for at, _ in changes for s in (-1, 0, 1)][1:] + [datetime(2024, 6, 30, 23, 59, 59, 999_999), datetime(2024, 7, 1)]
    df = spark.createDataFrame([(t, "clash", 1) for t in times] + [(None, "x", 2), (datetime(1989, 12, 31), "x", 3), (datetime(2031, 1, 1), "x", 4)], "t timestamp_ntz, month string, low int")
    told = timefmt.with_zone_name(df, "t", "zone", first=1990, last=2030)
    assert told.columns == ["t", "month", "low", "zone"]
    got = {r.t: r.zone for r in told.collect()}
    want = {t: t.replace(tzinfo=UTC).astimezone(ZoneInfo("Australia/Melbourne")).strftime("%Z") for t in times}
    assert got == want | {None: None, datetime(1989, 12, 31): None, datetime(2031, 1, 1): None} and told.count() == df.count()
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan
