"""The pathways: raw to T1 (one run, or all again) and T1 to T2."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlake.functions.columns import sound_run_id
from runlake.operators.canonical import consolidated, suspicious_runs
from runlake.operators.tabulate import observed
from runlake.plans import maintain
from runlake.sources import lake, manifest, publish

log = logging.getLogger(__name__)


REPORTED = 1_000  #: odd run ids that the log lists one by one


class NoSuccessfulRun(ValueError):
    """A rebuild needs at least one."""


def _due(spark: SparkSession, raw: str, t1: str, name: str, status: str, keys: manifest.Keys) -> list[manifest.Run]:
    done = lake.processed_run_ids(spark, t1)
    return manifest.successful(manifest.runs(spark, raw, name, keys=keys, done=done), status)


def next_run(spark: SparkSession, raw: str, t1: str, name: str = manifest.MANIFEST_NAME, status: str = manifest.SUCCESS, keys: manifest.Keys = manifest.KEYS) -> str:
    """The oldest run of that status that T1 lacks, or empty text."""
    return next((r.run_id for r in _due(spark, raw, t1, name, status, keys)), "")


def _tabulate(spark: SparkSession, runs: list[manifest.Run], pattern: str, status: str) -> DataFrame:
    return observed(manifest.frame(spark, runs), lake.observations(spark, runs, pattern), status, n_runs=len(runs))


def _named(runs: list[manifest.Run]) -> list[tuple[str, str]]:
    return [(r.run_id, r.location) for r in runs]


def increment(spark: SparkSession, raw: str, t1: str, name: str = manifest.MANIFEST_NAME, pattern: str = lake.CHUNKS, status: str = manifest.SUCCESS, keys: manifest.Keys = manifest.KEYS) -> str | None:
    """Add exactly one run to T1, the oldest that is due; None if none is. Callers repeat it. ``status`` marks the runs that count, ``keys`` what the manifests call things."""
    due = _due(spark, raw, t1, name, status, keys)
    if not due:
        log.info("T1 has every successful run")
        return None
    return publish.write_t1(_tabulate(spark, due[:1], pattern, status), t1, "append", runs=_named(due[:1]))


def catch_up(spark: SparkSession, raw: str, t1: str, name: str = manifest.MANIFEST_NAME, pattern: str = lake.CHUNKS, status: str = manifest.SUCCESS, keys: manifest.Keys = manifest.KEYS, at_once: int = 100) -> list[str]:
    """Add all runs that are due, oldest first, up to ``at_once`` in a job: the lake is looked through once, not once for each run. Returns their ids."""
    due = _due(spark, raw, t1, name, status, keys)
    for at in range(0, len(due), at_once):
        some = due[at : at + at_once]
        publish.write_t1(_spread(_tabulate(spark, some, pattern, status)), t1, "append", runs=_named(some))
    return [r.run_id for r in due]


def _spread(rows: DataFrame) -> DataFrame:
    """A run's rows go to one folder; the extra key keeps a large run in many files and tasks."""
    return rows.repartition("run_id", F.pmod(F.xxhash64("valid_time"), F.lit(16)))


def rebuild(spark: SparkSession, raw: str, t1: str, name: str = manifest.MANIFEST_NAME, pattern: str = lake.CHUNKS, status: str = manifest.SUCCESS, keys: manifest.Keys = manifest.KEYS) -> str:
    """T1 anew from all successful runs."""
    good = manifest.successful(manifest.runs(spark, raw, name, keys=keys), status)
    if not good:
        raise NoSuccessfulRun(f"no successful run below {raw}")
    return publish.write_t1(_spread(_tabulate(spark, good, pattern, status)), t1, "overwrite", runs=_named(good))


def _warn_of_odd_runs(spark: SparkSession, t1: str) -> None:
    """Run ids that aren't shaped like times, from T1's folders; they are in the log, not in the data."""
    odd = suspicious_runs(spark.createDataFrame([(r,) for r in sorted(lake.processed_run_ids(spark, t1))], "run_id string"), sound_run_id).limit(REPORTED + 1).collect()
    for row in odd[:REPORTED]:
        log.warning("run id %r is not a time; latest-run-wins goes by text", row.run_id)
    if len(odd) > REPORTED:
        log.warning("there are more such run ids; the report ends after %s", REPORTED)


def transform(spark: SparkSession, t1: str, t2: str, partition_by: tuple[str, ...] = ()) -> str | None:
    """T2 anew from T1, which is scanned once; None, and a message, if there is no T1."""
    if not lake.has_table(spark, t1):
        log.info("no T1 at %s: nothing to transform", t1)
        return None
    _warn_of_odd_runs(spark, t1)
    return publish.write_t2(consolidated(lake.read_t1(spark, t1)), t2, partition_by)


def transform_new(spark: SparkSession, t1: str, states: str, t2: str, partition_by: tuple[str, ...] = ()) -> str | None:
    """The same from states of keys, into which only the runs are merged that T1 has got since."""
    if not lake.has_table(spark, t1):
        log.info("no T1 at %s: nothing to transform", t1)
        return None
    _warn_of_odd_runs(spark, t1)
    if maintain.refresh(spark, t1, states) or not lake.has_table(spark, t2):
        publish.write_t2(maintain.read_t2(spark, states), t2, partition_by)
    return t2
