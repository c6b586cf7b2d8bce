"""Landing one run: a folder with chunks, a manifest that ends SUCCESS or FAILED, and a marker."""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Callable
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import SparkSession

from runlake.functions import timefmt
from runlake.sources import feed
from runlake.sources.files import Files
from runlake.sources.manifest import FAILED, MANIFEST_NAME, RUNNING, SUCCESS

log = logging.getLogger(__name__)


def chunk_name(start: datetime | None, end: datetime | None) -> str:
    if start is None and end is None:
        return "chunk_latest.jsonl"
    return f"chunk_{timefmt.token(start)}__{timefmt.token(end)}.jsonl"


def write_chunk(files: Files, folder: str, chunk: feed.Chunk) -> str:
    """One JSON object a line, as it came; an empty chunk is an empty file."""
    name = chunk_name(chunk.start, chunk.end)
    files.write_lines(f"{folder}/{name}", (json.dumps(row, ensure_ascii=False) for row in chunk.rows))
    return name


def manifest(config: dict[str, Any], location: str, start: Any, end: Any, run_id: str, status: str, extra: dict[str, Any] | None = None) -> dict[str, Any]:
    """What is known of a run. The API key is never part of it; ``extra`` overrides."""
    fmt, own = config["date_fmt"], feed.settings(config)
    low, high = timefmt.api_text(start, fmt), timefmt.api_text(end, fmt)
    #: What the lake's readers call things.
    return {
        "source": "space_weather", "dataset": "k_index",
        "run_id": run_id, "created_at_utc": run_id, "status": status, "location": location,
        "start_utc_str": low, "end_utc_str": high,
        "start_melb_str": timefmt.local_text(low, fmt), "end_melb_str": timefmt.local_text(high, fmt),
        "chunk_days": own.get("chunk_days"), "sleep_seconds": own.get("sleep_seconds"),
        "base_url": config.get("base_url"), "endpoint": config.get("endpoints", {}).get("k_index"),
    } | (extra or {})


def ingest_run(spark: SparkSession, config: dict[str, Any], location: str, start: Any = None, end: Any = None, raw: str | None = None, transport: feed.Transport = feed.over_http, clock: Callable[[], datetime] = lambda: datetime.now(UTC), sleep: Callable[[float], None] = time.sleep) -> str:
    """Fetch a range into a new run folder and return it. Bounds are checked first; a failure later leaves a FAILED manifest and is raised."""
    files, run_id = Files(spark), timefmt.new_run_id(clock)
    feed.plan(config, start, end)
    folder = f"{raw or feed.settings(config)['raw_base_dir']}/run_id={run_id}"
    if files.exists(folder):
        raise FileExistsError(f"{folder} is there already: one run a second")
    files.make(folder)
    tell = lambda status, **extra: files.write_json(f"{folder}/{MANIFEST_NAME}", manifest(config, location, start, end, run_id, status, extra))
    tell(RUNNING)
    try:
        names, rows = [], 0
        for chunk in feed.chunks(config, location, start, end, transport, sleep):
            names.append(write_chunk(files, folder, chunk))
            rows += len(chunk.rows)
            log.info("%s: %s observations", names[-1], len(chunk.rows))
        files.write(f"{folder}/_SUCCESS", "")
        tell(SUCCESS, total_rows=rows, chunk_files=names)
    except Exception as e:
        files.write(f"{folder}/_FAILED", repr(e))
        tell(FAILED, error=str(e))
        raise
    return folder
