from __future__ import annotations

import copy
import json
from datetime import datetime

import pytest

from runlake.sources import feed

CONFIG = {"api_key": "k", "base_url": "https://feed.example/api/", "endpoints": {"k_index": "get-k-index"}, "date_fmt": "%Y-%m-%d %H:%M:%S", "ingestion": {"k_index": {"chunk_days": 1, "sleep_seconds": 0.5}}}


def answering(status=200, text='{"data": [{"index": 3, "valid_time": "2024-01-01 00:00:00", "analysis_time": "2024-01-01 03:00:00"}]}'):
    seen = []

    def transport(url, body, timeout):
        seen.append((url, copy.deepcopy(body), timeout))
        return status, text

    return transport, seen


def with_(**own):
    config = copy.deepcopy(CONFIG)
    config["ingestion"]["k_index"] |= own
    return config


def test_request_leaves_open_bounds_out():
    transport, seen = answering()
    assert feed.post(CONFIG, "Site A", transport=transport)[0]["index"] == 3
    feed.post(CONFIG, "Site A", "2024-01-01 00:00:00", datetime(2024, 1, 2), transport)
    assert seen[0] == ("https://feed.example/api/get-k-index", {"api_key": "k", "options": {"location": "Site A"}}, 60)
    assert seen[1][1]["options"] == {"location": "Site A", "start": "2024-01-01 00:00:00", "end": "2024-01-02 00:00:00"}
    feed.post(with_(timeout_s=5), "Site A", transport=transport)
    assert seen[2][2] == 5


def test_failures_are_runtime_errors_and_no_data_is_no_rows():
    with pytest.raises(RuntimeError, match="500.*broken"):
        feed.post(CONFIG, "x", transport=answering(500, "broken")[0])

    def dead(*_):
        raise OSError("no route")

    with pytest.raises(RuntimeError) as e:
        feed.post(CONFIG, "x", transport=dead)
    assert isinstance(e.value.__cause__, OSError)
    assert feed.post(CONFIG, "x", transport=answering(200, "{}")[0]) == []


@pytest.mark.parametrize(("start", "end"), [("2024-01-01 00:00:00", None), (None, "2024-01-01 00:00:00"), (None, None)])
def test_open_ranges_are_one_request_without_pause(start, end):
    transport, seen = answering()
    slept = []
    got = list(feed.chunks(with_(chunk_days=0, sleep_seconds=-1), "x", start, end, transport, slept.append))
    assert len(got) == len(seen) == 1 and not slept
    assert (got[0].start is None, got[0].end is None) == (start is None, end is None)


def test_bounded_ranges_are_cut_and_paused_after_each_chunk():
    transport, seen = answering()
    slept = []
    got = list(feed.chunks(CONFIG, "x", "2024-01-01 00:00:00", "2024-01-03 00:00:00", transport, slept.append))
    assert [(c.start.day, c.end.day) for c in got] == [(1, 2), (2, 3)]
    assert slept == [0.5, 0.5]
    assert len(list(feed.chunks(CONFIG, "x", "2024-01-01 00:00:00", "2024-01-01 00:00:00", transport, slept.append))) == 1


@pytest.mark.parametrize("own", [{"chunk_days": 0}, {"chunk_days": 1.5}, {"chunk_days": None}, {"chunk_days": True}, {"sleep_seconds": -1}, {"sleep_seconds": "1"}])
def test_bad_settings_are_refused(own):
    with pytest.raises(ValueError):
        list(feed.chunks(with_(**own), "x", "2024-01-01 00:00:00", "2024-01-02 00:00:00", answering()[0]))


def test_start_after_end_is_refused():
    with pytest.raises(ValueError):
        feed.plan(CONFIG, "2024-01-02 00:00:00", "2024-01-01 00:00:00")


def test_chunks_are_fetched_one_at_a_time():
    transport, seen = answering()
    stream = feed.chunks(CONFIG, "x", "2024-01-01 00:00:00", "2024-01-09 00:00:00", transport, lambda _: None)
    next(stream)
    assert len(seen) == 1


def reader_of(config, transport, start="2024-01-01 00:00:00", end="2024-01-05 00:00:00", **more):
    return feed.FeedReader({"config": json.dumps(config), "location": "x", "start": start, "end": end} | more, transport, lambda: 100.0, more_sleep.append)


more_sleep: list[float] = []


def test_data_source_reads_the_same_rows_chunk_by_chunk():
    more_sleep.clear()
    transport, seen = answering()
    reader = reader_of(CONFIG, transport)
    parts = reader.partitions()
    rows = [row for p in parts for row in reader.read(p)]
    assert len(parts) == len(seen) == 4 and rows == [("x", "2024-01-01 00:00:00", "2024-01-01 03:00:00", "3")] * 4
    want = [c for c in feed.chunks(with_(sleep_seconds=0), "x", "2024-01-01 00:00:00", "2024-01-05 00:00:00", transport)]
    assert [(p.start, p.end) for p in parts] == [(c.start, c.end) for c in want]
    assert [b["options"] for _, b, _ in seen[:4]] == [b["options"] for _, b, _ in seen[4:]]
    assert more_sleep == [0.5, 1.0, 1.5]  # each chunk waits for its turn, whoever reads it


def test_a_failing_chunk_alone_is_asked_for_again():
    asked = []

    def transport(url, body, timeout):
        asked.append(body["options"]["start"])
        return (503, "busy") if asked.count("2024-01-02 00:00:00") in (1, 2) and asked[-1].startswith("2024-01-02") else (200, '{"data": [{"index": 1}]}')

    reader = reader_of(with_(sleep_seconds=0), transport)
    assert [row for p in reader.partitions() for row in reader.read(p)] == [("x", None, None, "1")] * 4
    assert asked.count("2024-01-02 00:00:00") == 3 and len(asked) == 6
    asked.clear()
    reader = reader_of(with_(sleep_seconds=0), transport, tries="2")
    with pytest.raises(RuntimeError, match="busy"):
        list(reader.read(reader.partitions()[1]))


def test_open_range_is_one_partition_without_pause():
    more_sleep.clear()
    reader = feed.FeedReader({"config": json.dumps(with_(sleep_seconds=-1)), "location": "x"}, answering()[0], sleep=more_sleep.append)
    (part,) = reader.partitions()
    assert len(list(reader.read(part))) == 1 and not more_sleep


def test_data_source_in_spark(spark):
    class Canned(feed.FeedSource):
        transport = staticmethod(lambda url, body, timeout: (200, '{"data": [{"index": 3}, {"index": null, "valid_time": "t"}]}'))

        @classmethod
        def name(cls):
            return "canned_feed"

    spark.dataSource.register(Canned)
    bounded = spark.read.format("canned_feed").options(config=json.dumps(with_(sleep_seconds=0)), location="x", start="2024-01-01 00:00:00", end="2024-01-08 00:00:00").load()
    assert bounded.rdd.getNumPartitions() == 7 and bounded.count() == 14
    rows = spark.read.format("canned_feed").option("config", json.dumps(CONFIG)).option("location", "x").load().collect()
    assert [tuple(r) for r in rows] == [("x", None, None, "3"), ("x", "t", None, None)]
