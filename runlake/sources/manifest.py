"""Run manifests: the authority on which runs count.

Spark's readers skip names that begin with ``_``. A few manifests are read on the driver, many at a time; from ``SPREAD`` on, Spark's tasks
read and check them (``spread``), where they reach the store.
"""

from __future__ import annotations

import json
import re
from collections.abc import Collection, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from runlake import schemas
from runlake.functions.timefmt import RUN_ID
from runlake.sources import spread
from runlake.sources.files import Files

SUCCESS, FAILED, RUNNING = "SUCCESS", "FAILED", "RUNNING"
MANIFEST_NAME = "_manifest.json"
READERS = 16
SPREAD = 100  #: manifests from which on a job costs less than the driver's own reads, of which one takes about 10 ms
CHECKED = "run_id string, location string, status string, folder string, fault string"


@dataclass(frozen=True)
class Keys:
    """What a manifest calls the run's id, its location and its status. Fixed values of the lake that ``ingest`` writes, as defaults."""

    run_id: str = "created_at_utc"
    location: str = "location"
    status: str = "status"


KEYS = Keys()


class LakeError(ValueError):
    """The raw lake breaks a rule that later steps rely on."""


@dataclass(frozen=True)
class Run:
    run_id: str
    location: str
    status: str
    folder: str


def run_in(path: str) -> str:
    found = re.findall(r"/run_id=([^/]+)/", path)
    if not found:
        raise LakeError(f"no run_id=... folder in {path}")
    return found[-1]


def parsed(path: str, text: str, strict: bool = False, keys: Keys = KEYS) -> Run:
    """A manifest, checked: an object with the required keys whose id is its folder's (and, if strict, well formed)."""
    try:
        value = json.loads(text)
    except json.JSONDecodeError as e:
        raise LakeError(f"{path} is not JSON: {e}") from e
    if not isinstance(value, dict):
        raise LakeError(f"{path} is not an object")
    if missing := [k for k in (keys.run_id, keys.location, keys.status) if k not in value]:
        raise LakeError(f"{path} lacks {', '.join(missing)}")
    run_id = run_in(path)
    if value[keys.run_id] != run_id:
        raise LakeError(f"{path} says {value[keys.run_id]}, its folder {run_id}")
    if strict and not re.fullmatch(RUN_ID.strip("^$"), run_id):
        raise LakeError(f"{path}: {run_id} is not a time")
    return Run(run_id, value[keys.location], value[keys.status], path.rpartition("/")[0])


def run_folders(spark: SparkSession, raw: str, reached: str | None = None) -> list[str]:
    """The run folders below ``raw``, at any depth, but none within another: a listing for each folder above them."""
    if reached:
        return spread.run_folders(reached)
    files, found, todo = Files(spark), [], [raw.rstrip("/")]
    while todo:
        at = todo.pop()
        for name, folder, _ in files.names(at):
            if folder:
                (found if name.startswith("run_id=") else todo).append(f"{at}/{name}")
    return sorted(found)


def checked(spark: SparkSession, folders: list[str], name: str = MANIFEST_NAME, strict: bool = False, keys: Keys = KEYS) -> DataFrame:
    """The manifests in these folders, read by tasks: what each says, or its fault. ``name`` may be a pattern. Folders without one give no row."""

    def row(folder: str, file: str, _: int, held: bytes) -> tuple:
        try:
            found = parsed(f"{folder}/{file}", held.decode(), strict, keys)
        except ValueError as e:  # also what isn't UTF-8
            return run_in(f"{folder}/"), None, None, folder, str(e)
        return found.run_id, _text(found.location), _text(found.status), folder, None

    return spread.for_files(spark, folders, (name,), row, CHECKED)


def _text(value: object) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value)


def table(spark: SparkSession, raw: str, name: str = MANIFEST_NAME, strict: bool = False, keys: Keys = KEYS) -> DataFrame:
    """(run_id, location, status, folder) of all runs below ``raw``, as a table: nothing but folder names passes through the driver.

    A manifest that breaks a rule, or a run that is there twice, fails the read. Where tasks don't reach the store, ``runs`` reads."""
    reached = spread.reached(spark, raw)
    if not reached:
        return spark.createDataFrame([(r.run_id, r.location, r.status, r.folder) for r in runs(spark, raw, name, strict, keys)], CHECKED.rpartition(",")[0])
    folders = run_folders(spark, raw, reached)
    own = [f for of in _by_run(folders).values() if len(of) > 1 for f in of]
    if own:
        _no_doubles((r.run_id, r.folder) for r in checked(spark, own, name, strict, keys).collect())  # of runs with several folders only
    return spread.strict(checked(spark, folders, name, strict, keys), "fault")


def _by_run(folders: list[str]) -> dict[str, list[str]]:
    by_run: dict[str, list[str]] = {}
    for folder in folders:
        by_run.setdefault(run_in(f"{folder}/"), []).append(folder)
    return by_run


def _no_doubles(found: Iterable[tuple[str, str]]) -> None:
    seen = set()
    for run_id, _ in found:
        if run_id in seen:
            raise LakeError(f"{run_id} is there twice")
        seen.add(run_id)


def runs(spark: SparkSession, raw: str, name: str = MANIFEST_NAME, strict: bool = False, keys: Keys = KEYS, done: Collection[str] = (), spread_from: int = SPREAD) -> list[Run]:
    """The runs below ``raw`` that aren't ``done``, oldest first. Each one's manifest is read and checked, whatever its status.

    A run that is done was checked when it was taken over: of it only the folder's name is read. A manifest lies directly in its run's
    folder; a folder without one is no run yet. From ``spread_from`` manifests on, tasks read them."""
    reached = spread.reached(spark, raw)
    by_run = _by_run(run_folders(spark, raw, reached))
    read = [folder for run_id, own in by_run.items() if run_id not in done or len(own) > 1 for folder in own]
    if reached and len(read) >= spread_from:
        found = checked(spark, read, name, strict, keys).collect()  # a short row a run that is due
        _no_doubles((r.run_id, r.folder) for r in found)
        due = [r for r in found if r.run_id not in done]
        if faults := sorted((r.folder, r.fault) for r in due if r.fault is not None):
            raise LakeError(faults[0][1])
        return sorted((Run(r.run_id, r.location, r.status, r.folder) for r in due), key=lambda r: r.run_id)
    files = Files(spark)
    with ThreadPoolExecutor(READERS) as readers:
        texts = {f: text for f, text in zip(read, readers.map(lambda f: files.read(f"{f}/{name}") if files.exists(f"{f}/{name}") else None, read), strict=True) if text is not None}
    _no_doubles((run_in(f"{f}/"), f) for f in texts)
    return sorted((parsed(f"{f}/{name}", text, strict, keys) for f, text in texts.items() if run_in(f"{f}/") not in done), key=lambda r: r.run_id)


def successful(every: list[Run], status: str = SUCCESS) -> list[Run]:
    return [r for r in every if r.status == status]


def frame(spark: SparkSession, every: list[Run]) -> DataFrame:
    return spark.createDataFrame([(r.run_id, r.location, r.status) for r in every], schemas.MANIFEST)
