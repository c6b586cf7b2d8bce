"""Run logs, settings, the command line, the stream."""

from __future__ import annotations

import logging

import pytest
from test_lake import NEW, OLD, line, run

from runlake import cli, config, runlog
from runlake.sources import lake
from runlake.streaming.follow import follow


def test_logs_are_renamed_by_status(tmp_path):
    done = runlog.logged("job", lambda log: log.info("hello"), tmp_path)
    assert done.name.startswith("job_") and done.name.endswith(".success.log") and "hello" in done.read_text()

    def boom(log):
        raise KeyError("lost")

    with pytest.raises(KeyError):
        runlog.logged("bad", boom, tmp_path)
    (left,) = tmp_path.glob("bad_*")
    assert left.name.endswith(".error.log") and left.read_text().count("Traceback") == 1
    with pytest.raises(KeyboardInterrupt):
        runlog.logged("cut", lambda log: (_ for _ in ()).throw(KeyboardInterrupt), tmp_path)
    assert [p.name for p in tmp_path.glob("cut_*")][0].endswith(".running.log")
    logging.basicConfig(force=True, handlers=[logging.NullHandler()])


def test_closing_an_absent_log_is_fine(tmp_path):
    assert runlog.renamed(tmp_path / "x.running.log", "success").name == "x.success.log"


def settings_file(tmp_path):
    path = tmp_path / "local.yaml"
    path.write_text(f"""
space_weather:
  api_key_env: RUNLAKE_TEST_KEY
  base_url: https://feed.example
  endpoints: {{k_index: k}}
  date_fmt: "%Y-%m-%d %H:%M:%S"
  ingestion: {{k_index: {{raw_base_dir: {tmp_path}/raw, manifest_file_name: _manifest.json, chunk_days: 1, sleep_seconds: 0}}}}
  preprocessing: {{k_index: {{T1_output_dir: {tmp_path}/t1}}}}
  transform: {{k_index: {{T2_output_dir: {tmp_path}/t2}}}}
""")
    return path


def test_settings_take_the_key_from_file_or_environment(tmp_path, monkeypatch):
    pytest.importorskip("yaml")
    path = settings_file(tmp_path)
    monkeypatch.delenv("RUNLAKE_TEST_KEY", raising=False)
    assert config.load(path, tmp_path / "none")["space_weather"]["api_key"] is None
    (tmp_path / ".env").write_text("# keys\nexport RUNLAKE_TEST_KEY='from file'\n")
    assert config.load(path, tmp_path / ".env")["space_weather"]["api_key"] == "from file"
    monkeypatch.setenv("RUNLAKE_TEST_KEY", "from environment")
    assert config.load(path, tmp_path / ".env")["space_weather"]["api_key"] == "from environment"


def test_commands_end_to_end(spark, tmp_path, monkeypatch):
    pytest.importorskip("yaml")
    monkeypatch.setattr(cli, "session", lambda name: spark)
    path, logs = str(settings_file(tmp_path)), str(tmp_path / "logs")
    run(tmp_path / "raw", OLD, chunks=[[line(0, 3)]])
    run(tmp_path / "raw", NEW, chunks=[[line(0, 4)]])
    cli.main(["--log_dir", logs, "tabulate", "--config_path", path])
    assert lake.processed_run_ids(spark, str(tmp_path / "t1")) == {OLD}
    cli.main(["--log_dir", logs, "tabulate", "--rebuild", "--config_path", path])
    cli.main(["--log_dir", logs, "consolidate", "--config_path", path])
    assert [r.kindex for r in lake.read_t2(spark, str(tmp_path / "t2")).collect()] == [4]
    asked = {}
    monkeypatch.setattr(cli, "ingest_run", lambda *a: asked.setdefault("a", a))
    cli.main(["--log_dir", logs, "ingest", "--location", "x", "--start", "None", "--end", "", "--config_path", path])
    assert asked["a"][2:] == ("x", None, "", None)
    logging.basicConfig(force=True, handlers=[logging.NullHandler()])


def test_stream_refreshes_the_consolidated_table(spark, tmp_path):
    from runlake.plans import pipeline

    raw, t1, t2 = str(tmp_path / "raw"), str(tmp_path / "t1"), str(tmp_path / "t2")
    run(tmp_path / "raw", OLD, chunks=[[line(0, 3)]])
    pipeline.increment(spark, raw, t1)
    follow(spark, t1, t2, str(tmp_path / "cp")).awaitTermination(60)
    assert [r.kindex for r in lake.read_t2(spark, t2).collect()] == [3]
    run(tmp_path / "raw", NEW, chunks=[[line(0, 5)]])
    pipeline.increment(spark, raw, t1)
    follow(spark, t1, t2, str(tmp_path / "cp")).awaitTermination(60)
    assert [(r.kindex, r.flag) for r in lake.read_t2(spark, t2).collect()] == [(5, True)]
