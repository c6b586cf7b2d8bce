"""A raw lake in a temporary folder, from landing to the consolidated table."""

from __future__ import annotations

import json
from datetime import UTC, datetime, timedelta
from pathlib import Path

import pyarrow as pa
import pytest
from test_feed import CONFIG, answering, with_

from runlake.plans import catalogue, pipeline
from runlake.sources import feed, ingest, lake, manifest, publish, spread
from runlake.sources.files import Files


def run(raw: Path, run_id: str, status="SUCCESS", location="Site A", chunks=None, **over):
    folder = raw / f"run_id={run_id}"
    folder.mkdir(parents=True)
    (folder / "_manifest.json").write_text(json.dumps({"created_at_utc": run_id, "location": location, "status": status, "more": [1]} | over, indent=2))
    for k, rows in enumerate(chunks or []):
        (folder / f"chunk-{k:04d}.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    return folder


def line(hour, index, day=1):
    return {"valid_time": f"2024-01-0{day} {hour:02d}:00:00", "analysis_time": f"2024-01-0{day} {hour:02d}:30:00", "index": index, "extra": "x"}


OLD, BAD, NEW = "20240101T000000Z", "20240102T000000Z", "20240103T000000Z"


@pytest.fixture
def raw(tmp_path):
    run(tmp_path / "raw", OLD, chunks=[[line(0, 3)]])
    run(tmp_path / "raw", BAD, "FAILED", chunks=[[line(0, 9)]])
    run(tmp_path / "raw", NEW, location="Site B", chunks=[[], []])
    return str(tmp_path / "raw")


def rows(spark, path):
    return sorted((tuple(r) for r in lake.read_t1(spark, path).collect()), key=str)


WANT = sorted([("Site A", datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 30), 3, OLD), ("Site B", None, None, None, NEW)], key=str)


def test_increments_take_one_run_each_oldest_first(spark, raw, tmp_path):
    t1 = str(tmp_path / "t1")
    assert pipeline.next_run(spark, raw, t1) == OLD
    assert pipeline.increment(spark, raw, t1) == t1 and len(rows(spark, t1)) == 1
    assert pipeline.next_run(spark, raw, t1) == NEW
    pipeline.increment(spark, raw, t1)
    assert rows(spark, t1) == WANT
    assert pipeline.next_run(spark, raw, t1) == "" and pipeline.increment(spark, raw, t1) is None


def test_rebuild_replaces_what_was_there(spark, raw, tmp_path):
    t1 = tmp_path / "t1"
    (t1 / "run_id=gone").mkdir(parents=True)
    (t1 / "run_id=gone" / "old.parquet").write_text("not even parquet")
    pipeline.rebuild(spark, raw, str(t1))
    assert rows(spark, str(t1)) == WANT
    assert sorted(p.name for p in tmp_path.iterdir()) == ["raw", "t1"]


def test_rebuild_needs_a_successful_run(spark, tmp_path):
    run(tmp_path / "raw", OLD, "RUNNING", chunks=[[line(0, 1)]])
    with pytest.raises(pipeline.NoSuccessfulRun):
        pipeline.rebuild(spark, str(tmp_path / "raw"), str(tmp_path / "t1"))


@pytest.mark.parametrize("spoil", ["not json", "[1]", '{"created_at_utc": "x", "location": "y"}', json.dumps({"created_at_utc": "another", "location": "y", "status": "FAILED"})])
def test_one_bad_manifest_stops_everything_even_of_a_failed_run(spark, raw, tmp_path, spoil):
    Path(raw, f"run_id={BAD}", "_manifest.json").write_text(spoil)
    for step in (pipeline.increment, pipeline.rebuild):
        with pytest.raises(manifest.LakeError):
            step(spark, raw, str(tmp_path / "t1"))


def test_duplicate_ids_are_refused(spark, raw):
    run(Path(raw, "again"), OLD)
    with pytest.raises(manifest.LakeError, match="twice"):
        manifest.runs(spark, raw)


def test_strict_ids(spark, tmp_path):
    run(tmp_path, "0007")
    assert manifest.runs(spark, str(tmp_path))[0].run_id == "0007"
    with pytest.raises(manifest.LakeError):
        manifest.runs(spark, str(tmp_path), strict=True)
    with pytest.raises(manifest.LakeError):
        manifest.run_in("/lake/other/_manifest.json")


def test_numeric_ids_stay_text_and_unfinished_chunks_are_ignored(spark, tmp_path):
    folder = run(tmp_path / "raw", "0007", chunks=[[line(0, 1)], []])
    (folder / "chunk-9.jsonl.tmp").write_text("half a li")
    pipeline.rebuild(spark, str(tmp_path / "raw"), str(tmp_path / "t1"))
    assert [r[4] for r in rows(spark, str(tmp_path / "t1"))] == ["0007"]
    assert lake.processed_run_ids(spark, str(tmp_path / "t1")) == {"0007"}


def test_runs_without_chunk_files_get_a_sentinel(spark, tmp_path):
    run(tmp_path / "raw", OLD)
    pipeline.rebuild(spark, str(tmp_path / "raw"), str(tmp_path / "t1"))
    assert rows(spark, str(tmp_path / "t1")) == [("Site A", None, None, None, OLD)]


def test_odd_numbers_missing_keys_and_bad_lines(spark, tmp_path):
    every = [line(0, "4"), line(1, 5.0), line(2, 2.5), line(3, 3.5), line(4, None), {"valid_time": "2024-01-01 05:00:00"}]
    run(tmp_path / "a", OLD, chunks=[every])
    seen = lake.observations(spark, manifest.runs(spark, str(tmp_path / "a"))).orderBy("valid_time").collect()
    assert [r.kindex for r in seen] == [4, 5, 2, 4, None, None] and seen[5].analysis_time is None
    for k, bad in enumerate(('{"index": 1', '{"index": "many"}', '{"valid_time": "soon"}')):
        folder = run(tmp_path / f"bad{k}", OLD)
        (folder / "chunk-0000.jsonl").write_text(bad + "\n")
        with pytest.raises(Exception):  # noqa: B017  whichever layer notices
            pipeline.rebuild(spark, str(tmp_path / f"bad{k}"), str(tmp_path / "t1"))
    assert not (tmp_path / "t1").exists()


def test_transform(spark, raw, tmp_path, caplog):
    t1, t2 = str(tmp_path / "t1"), str(tmp_path / "t2")
    with caplog.at_level("INFO"):
        assert pipeline.transform(spark, t1, t2) is None
    assert "no T1" in caplog.text and not Path(t2).exists()
    run(Path(raw), "odd-id", chunks=[[line(0, 7)]])
    pipeline.rebuild(spark, raw, t1)
    with caplog.at_level("WARNING"):
        assert pipeline.transform(spark, t1, t2) == t2
    assert "odd-id" in caplog.text
    assert sorted(p.name for p in Path(t2).iterdir()) == ["T2.parquet"]
    assert [tuple(r) for r in lake.read_t2(spark, t2).collect()] == [("Site A", datetime(2024, 1, 1), 7, True)]
    assert lake.read_t2(spark, t2).dtypes == [("location", "string"), ("valid_time", "timestamp_ntz"), ("kindex", "int"), ("flag", "boolean")]
    pipeline.transform(spark, t1, t2, ("location",))
    assert [p.name for p in Path(t2).iterdir()] == ["location=Site A"]


def test_a_failed_write_leaves_the_table(spark, raw, tmp_path):
    from pyspark.sql import functions as F

    t1 = str(tmp_path / "t1")
    pipeline.rebuild(spark, raw, t1)
    broken = lake.read_t1(spark, t1).withColumn("kindex", F.raise_error(F.lit("no")).cast("int"))
    for mode in ("overwrite", "append"):
        with pytest.raises(Exception, match="no"):
            publish.write_t1(broken, t1, mode)
        assert rows(spark, t1) == WANT
    with pytest.raises(ValueError):
        publish.write_t1(broken, t1, "merge")
    with pytest.raises(ValueError):
        publish.write_t1(broken, t1, partition_by=())
    assert sorted(p.name for p in tmp_path.iterdir()) == ["raw", "t1"]


def test_a_failed_swap_puts_the_old_table_back(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "f").write_text("old")
    with pytest.raises(Exception):  # noqa: B017
        publish.swap(Files(spark), str(tmp_path / "absent"), str(tmp_path / "t"))
    assert (tmp_path / "t" / "f").read_text() == "old"


def test_repeated_appends_do_not_double(spark, raw, tmp_path):
    t1 = str(tmp_path / "t1")
    pipeline.rebuild(spark, raw, t1)
    again = spark.createDataFrame(lake.read_t1(spark, t1).where(f"run_id = '{OLD}'").collect(), lake.read_t1(spark, t1).schema)
    publish.write_t1(again, t1)
    assert rows(spark, t1) == WANT


def test_single_file(spark, tmp_path):
    publish.single_file(spark.range(5), str(tmp_path / "five.parquet"))
    assert spark.read.parquet(str(tmp_path / "five.parquet")).count() == 5
    assert [p.name for p in tmp_path.iterdir()] == ["five.parquet"]


class Clock:
    now = datetime(2024, 5, 1, 12, tzinfo=UTC)

    def __call__(self):
        Clock.now += timedelta(seconds=1)
        return Clock.now


def test_ingest_lands_a_run_that_tabulates(spark, tmp_path):
    folder = Path(ingest.ingest_run(spark, with_(sleep_seconds=0), "Site Ä", "2024-01-01 00:00:00", "2024-01-03 00:00:00", str(tmp_path / "raw"), answering()[0], Clock()))
    told = json.loads((folder / "_manifest.json").read_text())
    assert told["status"] == "SUCCESS" and told["total_rows"] == 2 and "api_key" not in told
    assert told["chunk_files"] == ["chunk_20240101T000000Z__20240102T000000Z.jsonl", "chunk_20240102T000000Z__20240103T000000Z.jsonl"]
    assert told["created_at_utc"] == told["run_id"] == folder.name.removeprefix("run_id=")
    assert told["start_melb_str"] == "2024-01-01 11:00:00 AEDT" and told["chunk_days"] == 1
    assert sorted(p.name for p in folder.iterdir()) == sorted(["_manifest.json", "_SUCCESS", *told["chunk_files"]])
    assert list(told) == sorted(told)
    assert pipeline.rebuild(spark, str(tmp_path / "raw"), str(tmp_path / "t1"))
    assert {r[0] for r in rows(spark, str(tmp_path / "t1"))} == {"Site Ä"}
    assert lake.markers(spark, str(tmp_path / "raw")).select("marker").first().marker == "_SUCCESS"


def test_ingest_open_and_empty(spark, tmp_path):
    folder = Path(ingest.ingest_run(spark, CONFIG, "x", raw=str(tmp_path), transport=answering(200, "{}")[0], clock=Clock()))
    assert (folder / "chunk_latest.jsonl").read_text() == ""
    assert json.loads((folder / "_manifest.json").read_text())["start_melb_str"] is None


def test_a_failing_ingest_is_recorded_and_raised(spark, tmp_path):
    answers = iter([(200, '{"data": [{"index": 1}]}'), (503, "busy")])
    with pytest.raises(RuntimeError, match="busy"):
        ingest.ingest_run(spark, with_(sleep_seconds=0), "x", "2024-01-01 00:00:00", "2024-01-03 00:00:00", str(tmp_path), lambda *_: next(answers), Clock())
    (folder,) = tmp_path.iterdir()
    told = json.loads((folder / "_manifest.json").read_text())
    assert told["status"] == "FAILED" and "busy" in told["error"] and "busy" in (folder / "_FAILED").read_text()
    assert len(list(folder.glob("*.jsonl"))) == 1 and manifest.successful(manifest.runs(spark, str(tmp_path))) == []


def test_bad_bounds_leave_nothing_and_a_second_run_in_a_second_is_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        ingest.ingest_run(spark, CONFIG, "x", "2024-13-01 00:00:00", None, str(tmp_path / "raw"), answering()[0])
    assert not (tmp_path / "raw").exists()
    still = lambda: datetime(2024, 1, 1, tzinfo=UTC)
    ingest.ingest_run(spark, CONFIG, "x", raw=str(tmp_path / "raw"), transport=answering()[0], clock=still)
    with pytest.raises(FileExistsError):
        ingest.ingest_run(spark, CONFIG, "x", raw=str(tmp_path / "raw"), transport=answering()[0], clock=still)


def test_chunk_names_and_lines(spark, tmp_path):
    a = datetime(2024, 1, 1)
    assert ingest.chunk_name(None, None) == "chunk_latest.jsonl"
    assert ingest.chunk_name(a, None) == "chunk_20240101T000000Z__open.jsonl"
    assert ingest.chunk_name(None, a) == "chunk_open__20240101T000000Z.jsonl"
    name = ingest.write_chunk(Files(spark), str(tmp_path), feed.Chunk(a, None, [{"a": "ü", "b": 1}, {}]))
    assert (tmp_path / name).read_text() == '{"a": "ü", "b": 1}\n{}\n' and len(list(tmp_path.iterdir())) == 1


def test_moves_are_tried_again_but_not_for_ever():
    tries, pauses = [], []

    def stubborn(n):
        def step():
            tries.append(n)
            if len(tries) < n:
                raise OSError("held")
        return step

    publish.patiently(stubborn(3), pauses.append)
    assert len(tries) == 3 and pauses == [publish.PAUSE] * 2
    tries.clear()
    with pytest.raises(OSError, match="held"):
        publish.patiently(stubborn(4), pauses.append)
    assert len(tries) == 3


def test_runs_that_are_done_are_not_read_again(spark, tmp_path):
    for k in (1, 2):
        folder = tmp_path / f"run_id=2024010{k}T000000Z"
        folder.mkdir()
        (folder / "about.json").write_text(json.dumps({"run": folder.name[7:], "site": "x", "state": "done"}) if k == 2 else "not JSON")
    keys = manifest.Keys("run", "site", "state")
    (left,) = manifest.runs(spark, str(tmp_path), "about.json", keys=keys, done={"20240101T000000Z"})
    assert (left.run_id, left.location) == ("20240102T000000Z", "x") and manifest.successful([left], "done") == [left]
    with pytest.raises(manifest.LakeError):
        manifest.runs(spark, str(tmp_path), "about.json", keys=keys)


def test_chunks_are_written_in_pieces_whole_or_not_at_all(spark, tmp_path):
    lines = [f"{k:07d}" * 10 for k in range(20_000)]
    Files(spark).write_lines(str(tmp_path / "all"), iter(lines))
    assert (tmp_path / "all").read_text() == "".join(x + "\n" for x in lines)

    def breaks():
        yield from lines
        raise OSError("gone")

    with pytest.raises(OSError, match="gone"):
        Files(spark).write_lines(str(tmp_path / "half"), breaks())
    assert [p.name for p in tmp_path.iterdir()] == ["all"]


def test_markers_of_many_runs(spark, tmp_path):
    for k in range(40):
        folder = run(tmp_path / "deep" / str(k % 3), f"2024010100{k:04d}Z", "SUCCESS")
        (folder / ("_SUCCESS" if k % 2 else "_FAILED")).write_text(str(k))
    got = sorted(tuple(r) for r in lake.markers(spark, str(tmp_path)).collect())
    assert got == sorted((f"2024010100{k:04d}Z", "_SUCCESS" if k % 2 else "_FAILED", str(k)) for k in range(40))


def both(spark, raw, **more):
    """The runs as the driver reads them and as tasks do: what is found, or what is said of it."""
    out = []
    for spread_from in (10**9, 0):
        try:
            out.append([(r.run_id, r.location, r.status, r.folder.removeprefix("file:")) for r in manifest.runs(spark, str(raw), spread_from=spread_from, **more)])
        except manifest.LakeError as e:
            out.append(str(e).removeprefix("file:"))
    return out


def test_tasks_read_manifests_as_the_driver_does(spark, tmp_path):
    for k in range(30):
        run(tmp_path / "a%20b" / str(k % 3), f"2024010100{k:04d}Z", "FAILED" if k % 4 == 0 else "SUCCESS", location=None if k == 7 else "Site Ä", start=None)
    (tmp_path / "a%20b" / "run_id=later").mkdir()  # no manifest yet
    driver, tasks = both(spark, tmp_path)
    assert driver == tasks and len(tasks) == 30
    driver, tasks = both(spark, tmp_path, done={f"2024010100{k:04d}Z" for k in range(29)})
    assert driver == tasks and len(tasks) == 1
    told = manifest.table(spark, str(tmp_path))
    assert sorted(r.run_id for r in told.collect()) == [f"2024010100{k:04d}Z" for k in range(30)] and told.columns == ["run_id", "location", "status", "folder"]


@pytest.mark.parametrize("spoil", [b"{", b"[]", b'{"location": "x", "status": "SUCCESS"}', b'{"created_at_utc": "other", "location": "x", "status": "SUCCESS"}', b"\xff", b""])
def test_tasks_refuse_what_the_driver_refuses(spark, tmp_path, spoil):
    run(tmp_path, OLD)
    (run(tmp_path, BAD) / "_manifest.json").write_bytes(spoil)
    if spoil != b"\xff":
        driver, tasks = both(spark, tmp_path)
        assert isinstance(driver, str) and driver == tasks
    with pytest.raises(manifest.LakeError):
        manifest.runs(spark, str(tmp_path), spread_from=0)
    assert [r.run_id for r in manifest.runs(spark, str(tmp_path), done={BAD}, spread_from=0)] == [OLD]
    with pytest.raises(Exception, match="_manifest.json|utf-8"):
        manifest.table(spark, str(tmp_path)).count()


def test_tasks_see_runs_that_are_there_twice(spark, tmp_path):
    run(tmp_path / "a", OLD)
    run(tmp_path / "b", OLD)
    run(tmp_path, NEW)
    for done in ((), {OLD}):
        with pytest.raises(manifest.LakeError, match="twice"):
            manifest.runs(spark, str(tmp_path), done=done, spread_from=0)
    with pytest.raises(manifest.LakeError, match="twice"):
        manifest.table(spark, str(tmp_path))
    (tmp_path / "b" / f"run_id={OLD}" / "_manifest.json").unlink()  # no run any more
    assert sorted(r.run_id for r in manifest.table(spark, str(tmp_path)).collect()) == [OLD, NEW] == [r.run_id for r in manifest.runs(spark, str(tmp_path), spread_from=0)]


def test_an_empty_lake_and_one_out_of_reach(spark, tmp_path, monkeypatch):
    assert manifest.runs(spark, str(tmp_path), spread_from=0) == [] and manifest.table(spark, str(tmp_path)).collect() == []
    assert spread.reached(spark, str(tmp_path / "none")) is None and manifest.runs(spark, str(tmp_path / "none")) == []
    (run(tmp_path, OLD) / "_SUCCESS").write_text("fine")
    seen = lake.markers(spark, str(tmp_path)).collect()
    with monkeypatch.context() as m:
        m.setattr(spread, "reached", lambda *_: None)
        assert [tuple(r)[:3] for r in manifest.table(spark, str(tmp_path)).collect()] == [(OLD, "Site A", "SUCCESS")]
        assert lake.markers(spark, str(tmp_path)).collect() == seen
    with pytest.raises(ValueError):
        spread.store("ftp://host/lake")


def test_tasks_list_chunks_as_the_driver_does(spark, tmp_path):
    for k in range(12):
        folder = run(tmp_path, f"2024010100{k:04d}Z", chunks=[[line(0, k)]] if k % 3 else [])
        (folder / "chunk-0009.jsonl.tmp").write_text("{}")
        if k % 3 == 0:
            (folder / "chunk-0001.jsonl").touch()  # empty
    every = manifest.runs(spark, str(tmp_path))
    driver, tasks = (lake.with_chunks(spark, every, spread_from=n) for n in (10**9, 0))
    assert driver == tasks and len(tasks) == 8
    assert lake.observations(spark, every).count() == 8


def test_small_files_are_taken_many_a_task(spark, tmp_path):
    for k in range(450):
        folder = tmp_path / f"run_id={k:04d}"
        folder.mkdir()
        (folder / "_note").write_text(str(k))
    folders = spread.run_folders(f"file:{tmp_path}")
    rows = spread.texts(spark, folders, ("_note",))
    assert rows.rdd.getNumPartitions() == 3
    assert sorted((r.folder, r.content) for r in rows.collect()) == [(f, str(k)) for k, f in enumerate(folders)]


def test_tasks_grow_with_very_many_folders(spark):
    """A hundredth of the folders a task, up to 2,000, so that tasks' own costs don't grow with the lake."""
    for n, tasks in ((450, 3), (50_000, 100), (540_000, 270)):
        rows = spread.listed(spark, [f"file:/none/run_id={k}" for k in range(n)])
        assert rows.rdd.getNumPartitions() == tasks
    assert spread.listed(spark, [f"file:/none/run_id={k}" for k in range(50_000)]).count() == 0  # gone since


def test_lines_lie_as_they_go_into_files(monkeypatch):
    rows = [("a", "x", "1"), ("a", "x", ""), ("a", "y", "ä"), ("b", "x", "3"), ("b", "x", "4"), ("b", "x", "5")]
    monkeypatch.setattr(spread, "LINES", 2)
    for kind in (pa.string(), pa.large_string()):
        every = [pa.RecordBatch.from_arrays([pa.array(c, kind) for c in zip(*some, strict=True)], ["folder", "name", "line"]) for some in (rows[:4], rows[4:])]
        told = [(f, n, piece.to_pybytes().decode()) for f, n, piece in spread._stretches([every[0].slice(0, 0), *every, every[1].slice(1, 1)])]
        assert told == [("a", "x", "1\n\n"), ("a", "y", "ä\n"), ("b", "x", "3\n"), ("b", "x", "4\n5\n"), ("b", "x", "5\n")]


def test_tasks_write_files_in_their_places(spark, tmp_path):
    n = 3 * spread.LINES + 7
    rows = spark.range(n).selectExpr("'run_id=a%20b' as folder", "'chunk' as name", "lpad(id, 6, '0') as line")  # a file longer than what is held
    rows = rows.unionByName(spark.range(40).selectExpr("concat('run_id=', id % 20) as folder", "if(id < 20, '_manifest.json', 'chunk') as name", "concat('ä', id) as line"))
    for _ in range(2):  # again: the same files
        assert spread.write_lines(spark, rows, f"file:{tmp_path}/raw") == 41
        assert sorted(p.relative_to(tmp_path / "raw").as_posix() for p in (tmp_path / "raw").rglob("*") if p.is_file()) == sorted(["run_id=a%20b/chunk"] + [f"run_id={k}/{name}" for k in range(20) for name in ("_manifest.json", "chunk")])
        assert sorted((tmp_path / "raw" / "run_id=a%20b" / "chunk").read_text().splitlines()) == [f"{k:06d}" for k in range(n)]
        assert [(tmp_path / "raw" / "run_id=7" / name).read_text() for name in ("_manifest.json", "chunk")] == ["ä7\n", "ä27\n"]
    assert spread.write_lines(spark, rows.limit(0), f"{tmp_path}/none") == 0


def test_tasks_leave_no_part_of_a_file(spark, tmp_path, monkeypatch):
    one = spark.range(1)
    for bad in ("string(null) as folder, 'a' as name, 'x' as line", "'f' as folder, string(null) as name, 'x' as line", "'f' as folder, 'a' as name, string(null) as line"):
        with pytest.raises(Exception, match="without a name|NoneType"):
            spread.write_lines(spark, one.selectExpr(*bad.split(", ")), str(tmp_path))
    assert not [p for p in tmp_path.rglob("*") if p.is_file()]
    monkeypatch.setattr(spread, "reached", lambda *_: None)
    with pytest.raises(ValueError, match="no tasks write"):
        spread.write_lines(spark, one.selectExpr("'f' as folder", "'a' as name", "'x' as line"), str(tmp_path))


@pytest.fixture
def users(spark, tmp_path):
    spark.range(1000).selectExpr("id as event_id", "timestamp_ntz'2024-01-01 00:00:00' as ts", "id % 50 as user_id", "'click' as event_type", "double(id) as value").write.parquet(str(tmp_path / "events.parquet"))
    return catalogue.lake_of_users(spark, str(tmp_path))


def test_the_lake_of_users_is_written_once(users):
    """Two files a run, and nothing that a committer moved: no sums of them, no marks above."""
    raw = Path(users.removeprefix("file:"))
    assert sorted(p.name for p in raw.iterdir()) == sorted(f"run_id=u{k}" for k in range(50))
    assert {len(list(p.iterdir())) for p in raw.iterdir()} == {1, 2}  # odd users have no even events, thus no chunk
    (chunk,) = (raw / "run_id=u4").glob("*.json")
    assert len(chunk.read_text().splitlines()) == 20 and json.loads(chunk.read_text().splitlines()[0])["valid_time"] == "2024-01-01 00:00:00"


def test_a_listing_of_users_finds_what_was_written(spark, users):
    """A chunk a run that has values, whole, and nothing beside it and the manifest."""
    found = spread.listed(spark, manifest.run_folders(spark, users, spread.reached(spark, users))).collect()
    assert sorted(r.name for r in found) == ["chunk-0000.json"] * 25 + ["manifest.txt"] * 50 and all(r.bytes for r in found)


def test_manifests_of_users_are_read_by_name_too(spark, users):
    """What the driver reads, by the file's name, is what tasks read by a pattern."""
    tasks = manifest.table(spark, users, "*.txt").select("run_id", "location", "status").collect()
    driver = manifest.runs(spark, users, "manifest.txt", spread_from=10**9)
    assert sorted(map(tuple, tasks)) == sorted((r.run_id, r.location, r.status) for r in driver) and len(driver) == 50
