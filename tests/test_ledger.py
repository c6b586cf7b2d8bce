"""The ledger, appends that are killed, and T2 maintained run by run."""

from __future__ import annotations

import random
from datetime import datetime
from pathlib import Path

import pytest
from test_lake import line, rows, run

from runlake import schemas
from runlake.operators import canonical
from runlake.plans import maintain, pipeline
from runlake.sources import lake, ledger, manifest, publish
from runlake.sources.files import Files

RUN = "2024010{}T000000Z"


def test_entries_merge_and_say_the_same(spark, tmp_path):
    log, want, since = ledger.Ledger(spark, str(tmp_path)), {}, {}
    rng = random.Random(1)
    for number in range(1, 140):
        change = {f"k{rng.randrange(30)}": None if rng.random() < 0.2 else number}
        assert log.append(change) == number
        for k, v in change.items():
            want.pop(k, None), since.pop(k, None)
            if v is not None:
                want[k], since[k] = v, number
    state = log.state()
    assert (state.version, state.values, state.since) == (139, want, since)
    names = sorted(p.name for p in (tmp_path / "_ledger").iterdir())
    assert len(names) <= 3 * ledger.FAN and names[0] == "000000000001-000000000064.json"


def test_what_a_merge_left_behind_is_ignored(spark, tmp_path):
    log = ledger.Ledger(spark, str(tmp_path))
    for k in range(9):
        log.append({"k": k})
    (tmp_path / "_ledger" / "000000000003-000000000003.json").write_text("not deleted yet")
    assert log.state().values == {"k": 8} and log.state().since == {"k": 9}
    (tmp_path / "_ledger" / "000000000001-000000000008.json").unlink()
    with pytest.raises(OSError, match="lacks entry 1"):
        log.state()


def test_of_two_writers_one_is_next(spark, tmp_path, monkeypatch):
    one, two = ledger.Ledger(spark, str(tmp_path)), ledger.Ledger(spark, str(tmp_path))
    assert one.append({"a": 1}) == 1
    before = two._covers()
    stale = iter([before, before])
    assert one.append({"b": 2}) == 2
    real = two._covers
    monkeypatch.setattr(two, "_covers", lambda: next(stale, None) or real())
    assert two.append({"c": 3}) == 3  # its number was taken, so it took the next
    with pytest.raises(ledger.Conflict):
        one.append({"d": 4}, expected=2)
    assert one.state().values == {"a": 1, "b": 2, "c": 3} and ledger.Ledger(spark, str(tmp_path / "none")).state().version == 0


def lake_of(tmp_path, n, **more):
    for k in range(1, n + 1):
        run(tmp_path / "raw", RUN.format(k), chunks=[[line(h, (k + h) % 3) for h in range(k % 3)]], location=f"Site {k % 2}", **more)
    return str(tmp_path / "raw"), str(tmp_path / "t1")


def test_an_increment_lists_as_much_however_many_runs_there_are(spark, tmp_path, monkeypatch):
    raw, t1 = lake_of(tmp_path, 9)
    calls, counted = [], []
    names, walk = Files.names, Files.walk
    monkeypatch.setattr(Files, "names", lambda self, uri: calls.append(uri) or names(self, uri))
    monkeypatch.setattr(Files, "walk", lambda self, uri: calls.append(uri) or walk(self, uri))
    while pipeline.increment(spark, raw, t1):
        counted.append(len(calls))
        calls.clear()
    assert len(counted) == 9 and max(counted[1:]) <= min(counted[1:]) + 4  # but for a merge of the ledger
    assert not any("run_id=20240101T000000Z" in c for c in calls)
    assert len({r[4] for r in rows(spark, t1)}) == 9


def test_catching_up_looks_once_and_gives_the_same(spark, tmp_path):
    raw, t1 = lake_of(tmp_path, 7)
    assert pipeline.catch_up(spark, raw, t1, at_once=3) == [RUN.format(k) for k in range(1, 8)]
    assert pipeline.catch_up(spark, raw, t1) == []
    pipeline.rebuild(spark, raw, str(tmp_path / "again"))
    assert rows(spark, t1) == rows(spark, str(tmp_path / "again"))
    assert ledger.Ledger(spark, t1).state().version == 4  # its epoch, and three appends


@pytest.mark.parametrize("point", ["staged", "moved"])
def test_a_killed_append_is_not_seen_and_done_again(spark, tmp_path, monkeypatch, point):
    raw, t1 = lake_of(tmp_path, 2)
    pipeline.increment(spark, raw, t1)
    before, append = rows(spark, t1), ledger.Ledger.append

    def killed(*_, **__):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        if point == "staged":
            m.setattr(publish, "commit", killed)
        else:
            m.setattr(ledger.Ledger, "append", lambda self, changes, expected=None: killed() if "run_id=" in str(changes) else append(self, changes, expected))
        m.setattr(Files, "delete", lambda self, uri: None)  # what a killed process would not tidy
        with pytest.raises(KeyboardInterrupt):
            pipeline.increment(spark, raw, t1)
    if point == "staged":
        assert rows(spark, t1) == before
    assert lake.processed_run_ids(spark, t1) == {RUN.format(1)} and pipeline.next_run(spark, raw, t1) == RUN.format(2)
    pipeline.increment(spark, raw, t1)
    publish.drop_leftovers(Files(spark), t1)
    pipeline.rebuild(spark, raw, str(tmp_path / "again"))
    assert rows(spark, t1) == rows(spark, str(tmp_path / "again")) and pipeline.increment(spark, raw, t1) is None
    assert sorted(p.name[:7] for p in Path(t1).iterdir()) == ["_ledger", "run_id=", "run_id="]


def test_a_partition_that_vanished_is_due_again(spark, tmp_path):
    raw, t1 = lake_of(tmp_path, 2)
    pipeline.catch_up(spark, raw, t1)
    Path(t1, f"run_id={RUN.format(1)}").rename(tmp_path / "elsewhere")
    assert pipeline.next_run(spark, raw, t1) == RUN.format(1)


def test_a_table_without_a_ledger_is_adopted(spark, tmp_path):
    raw, t1 = lake_of(tmp_path, 3)
    spark.createDataFrame([("Site 1", None, None, None, RUN.format(1))], schemas.T1).write.partitionBy("run_id").parquet(t1)
    assert lake.processed_run_ids(spark, t1) == {RUN.format(1)}
    assert pipeline.catch_up(spark, raw, t1) == [RUN.format(2), RUN.format(3)]
    assert lake.processed_run_ids(spark, t1) == {RUN.format(k) for k in (1, 2, 3)}


def test_the_raw_lake_is_scanned_once(spark, tmp_path, monkeypatch):
    raw, t1 = lake_of(tmp_path, 4)
    scans = []
    read = lake.observations
    monkeypatch.setattr(lake, "observations", lambda *a: scans.append(1) or read(*a))
    write = publish.write_t1

    def counted(df, *a, **k):
        plan = df._jdf.queryExecution().executedPlan().toString()
        scans.append(plan.count("FileScan json"))
        return write(df, *a, **k)

    monkeypatch.setattr(publish, "write_t1", counted)
    pipeline.rebuild(spark, raw, t1)
    assert scans == [1, 1] and len([r for r in rows(spark, t1) if r[1] is None]) == 1  # the run without observations has its sentinel


def t2_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_t2_by_increments_is_t2_anew_after_every_run(spark, tmp_path, seed):
    rng = random.Random(seed)
    maybe = lambda x: None if rng.random() < 0.15 else x
    t1, states = str(tmp_path / "t1"), str(tmp_path / "states")
    order = [RUN.format(k) for k in range(1, 6)]
    rng.shuffle(order)
    for number, run_id in enumerate(order):
        own = [(maybe(rng.choice("AB")), maybe(datetime(2024, rng.randrange(1, 4), 1, rng.randrange(2))), None, maybe(rng.randrange(3)), run_id) for _ in range(12)]
        publish.write_t1(spark.createDataFrame(own, schemas.T1), t1)
        assert maintain.refresh(spark, t1, states) == 1
        assert t2_of(maintain.read_t2(spark, states)) == t2_of(canonical.build_t2(lake.read_t1(spark, t1)))
    assert maintain.refresh(spark, t1, states) == 0
    publish.write_t1(spark.createDataFrame([("A", datetime(2024, 1, 1), None, 7, order[0])], schemas.T1), t1)  # a run appended again
    assert maintain.refresh(spark, t1, states) == 5
    assert t2_of(maintain.read_t2(spark, states)) == t2_of(canonical.build_t2(lake.read_t1(spark, t1)))
    publish.write_t1(spark.createDataFrame([("C", datetime(2025, 1, 1), None, 1, "new")], schemas.T1), t1, "overwrite")  # a table made anew
    assert maintain.refresh(spark, t1, states) == 1
    assert t2_of(maintain.read_t2(spark, states)) == [("C", datetime(2025, 1, 1), 1, False)]


def test_a_refresh_touches_only_the_months_of_new_runs(spark, tmp_path):
    t1, states = str(tmp_path / "t1"), str(tmp_path / "states")
    day = lambda month: datetime(2024, month, 1)
    publish.write_t1(spark.createDataFrame([("A", day(m), None, m, RUN.format(1)) for m in (1, 2, 3)], schemas.T1), t1)
    maintain.refresh(spark, t1, states)
    before = dict(ledger.Ledger(spark, states).state().values)
    publish.write_t1(spark.createDataFrame([("A", day(2), None, 9, RUN.format(2)), ("B", None, None, None, RUN.format(2))], schemas.T1), t1)
    maintain.refresh(spark, t1, states)
    after = ledger.Ledger(spark, states).state().values
    assert [m for m in before if m.startswith("month") and before[m] != after[m]] == ["month=2024-02"]
    assert t2_of(maintain.read_t2(spark, states)) == [("A", day(1), 1, False), ("A", day(2), 9, True), ("A", day(3), 3, False)]
    plan = maintain.read_t2(spark, states)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_a_killed_refresh_has_not_happened(spark, tmp_path, monkeypatch):
    t1, states = str(tmp_path / "t1"), str(tmp_path / "states")
    publish.write_t1(spark.createDataFrame([("A", datetime(2024, 1, 1), None, 1, RUN.format(1))], schemas.T1), t1)
    maintain.refresh(spark, t1, states)
    publish.write_t1(spark.createDataFrame([("A", datetime(2024, 1, 1), None, 2, RUN.format(2))], schemas.T1), t1)
    before = t2_of(maintain.read_t2(spark, states))

    def killed(*_, **__):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(ledger.Ledger, "append", killed)
        with pytest.raises(KeyboardInterrupt):
            maintain.refresh(spark, t1, states)
    assert t2_of(maintain.read_t2(spark, states)) == before
    assert maintain.refresh(spark, t1, states) == 1
    assert t2_of(maintain.read_t2(spark, states)) == [("A", datetime(2024, 1, 1), 2, True)]


def test_transform_from_states(spark, tmp_path, caplog):
    raw, t1 = lake_of(tmp_path, 3)
    states, t2, anew = (str(tmp_path / x) for x in ("states", "t2", "anew"))
    with caplog.at_level("INFO"):
        assert pipeline.transform_new(spark, t1, states, t2) is None
    run(Path(raw), "odd-id", chunks=[[line(0, 7)]])
    pipeline.catch_up(spark, raw, t1)
    with caplog.at_level("WARNING"):
        assert pipeline.transform_new(spark, t1, states, t2) == t2
    assert "odd-id" in caplog.text
    pipeline.transform(spark, t1, anew)
    assert t2_of(lake.read_t2(spark, t2)) == t2_of(lake.read_t2(spark, anew)) and [p.name for p in Path(t2).iterdir()] == ["T2.parquet"]


def test_run_folders_are_found_at_any_depth(spark, tmp_path):
    run(tmp_path / "raw" / "deep" / "er", RUN.format(1))
    (tmp_path / "raw" / f"run_id={RUN.format(2)}").mkdir()  # no manifest yet
    assert [r.run_id for r in manifest.runs(spark, str(tmp_path / "raw"))] == [RUN.format(1)]
