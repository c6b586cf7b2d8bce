"""The HTTP feed: one request, a range in chunks, and the same as a Spark data source.

Transport, clock and sleep are injected, so nothing here needs a network to be tested.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime
from typing import Any

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from runlake.functions import timefmt

#: (url, body, timeout in seconds) to (status, text).
Transport = Callable[[str, dict[str, Any], float], tuple[int, str]]


@dataclass(frozen=True)
class Chunk:
    start: datetime | None
    end: datetime | None
    rows: list[dict[str, Any]]


def over_http(url: str, body: dict[str, Any], timeout: float) -> tuple[int, str]:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"}, method="POST")
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return answer.status, answer.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode(errors="replace")


def settings(config: dict[str, Any]) -> dict[str, Any]:
    return config.get("ingestion", {}).get("k_index", {})


def request(config: dict[str, Any], location: str, start: Any = None, end: Any = None) -> tuple[str, dict[str, Any]]:
    """The url and the body of one request; absent bounds are left out."""
    fmt = config["date_fmt"]
    bounds = {"start": timefmt.api_text(start, fmt), "end": timefmt.api_text(end, fmt)}
    options = {"location": location} | {k: v for k, v in bounds.items() if v is not None}
    return f"{config['base_url'].rstrip('/')}/{config['endpoints']['k_index']}", {"api_key": config["api_key"], "options": options}


def post(config: dict[str, Any], location: str, start: Any = None, end: Any = None, transport: Transport = over_http) -> list[dict[str, Any]]:
    """The observations of one request. RuntimeError if it fails or isn't answered with 200; no ``data`` is no observations."""
    url, body = request(config, location, start, end)
    try:
        status, text = transport(url, body, settings(config).get("timeout_s", 60))
    except Exception as e:
        raise RuntimeError(f"request to {url} failed: {e}") from e
    if status != 200:
        raise RuntimeError(f"{url} answered {status}: {text}")
    return json.loads(text).get("data", [])


def plan(config: dict[str, Any], start: Any, end: Any) -> list[tuple[datetime | None, datetime | None]]:
    """The requests for a range: one if a bound is open, else one for each ``chunk_days``."""
    fmt = config["date_fmt"]
    low, high = (None if x is None else timefmt.parse(x, fmt) for x in (start, end))
    if low is None or high is None:
        return [(low, high)]
    if low > high:
        raise ValueError(f"start {low} is after end {high}")
    days, pause = settings(config).get("chunk_days"), settings(config).get("sleep_seconds")
    if isinstance(days, bool) or not isinstance(days, int) or days <= 0:
        raise ValueError(f"chunk_days must be a whole number above 0, not {days!r}")
    if isinstance(pause, bool) or not isinstance(pause, int | float) or pause < 0:
        raise ValueError(f"sleep_seconds must be a number from 0 on, not {pause!r}")
    return timefmt.steps(low, high, days)


def chunks(config: dict[str, Any], location: str, start: Any = None, end: Any = None, transport: Transport = over_http, sleep: Callable[[float], None] = time.sleep) -> Iterator[Chunk]:
    """One chunk at a time; after each of a bounded range comes the pause that the feed's limits ask for."""
    parts = plan(config, start, end)
    bounded = parts[0][0] is not None and parts[0][1] is not None
    for low, high in parts:
        yield Chunk(low, high, post(config, location, low, high, transport))
        if bounded:
            sleep(settings(config)["sleep_seconds"])


@dataclass
class ChunkPartition(InputPartition):
    """One request; ``number`` is its place in the range, ``bounded`` whether it has a pause to keep."""

    number: int
    start: datetime | None
    end: datetime | None
    bounded: bool


class FeedSource(DataSource):
    """``spark.read.format("observation_feed")``: options location, start, end, config (JSON), tries. One partition a chunk.

    The feed limits its rate, not who asks: chunk k isn't asked for before k pauses have passed since the plan was made, so requests stay
    a pause apart however many tasks run. A chunk that fails is asked for again by its own task, ``tries`` times in all (3), a pause apart."""

    transport: Transport = staticmethod(over_http)

    @classmethod
    def name(cls) -> str:
        return "observation_feed"

    def schema(self) -> str:
        return "location string, valid_time string, analysis_time string, index string"

    def reader(self, schema) -> DataSourceReader:
        return FeedReader(self.options, type(self).transport)


class FeedReader(DataSourceReader):
    def __init__(self, options: dict[str, str], transport: Transport, clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep) -> None:
        self.options, self.transport, self.clock, self.sleep = dict(options), transport, clock, sleep
        self.began = clock()

    def partitions(self) -> list[InputPartition]:
        parts = plan(json.loads(self.options["config"]), self.options.get("start"), self.options.get("end"))
        return [ChunkPartition(k, low, high, low is not None and high is not None) for k, (low, high) in enumerate(parts)]

    def read(self, partition: ChunkPartition) -> Iterator[tuple]:
        config, location, tries = json.loads(self.options["config"]), self.options["location"], int(self.options.get("tries", 3))
        pause = settings(config)["sleep_seconds"] if partition.bounded else 0
        wait = self.began + partition.number * pause - self.clock()
        if wait > 0:
            self.sleep(wait)
        for left in reversed(range(tries)):
            try:
                rows = post(config, location, partition.start, partition.end, self.transport)
                break
            except RuntimeError:
                if not left:
                    raise
                self.sleep(pause)
        for row in rows:
            yield (location, *(None if row.get(k) is None else str(row[k]) for k in ("valid_time", "analysis_time", "index")))
