"""Observations of successful runs, and one sentinel row for each successful run that has none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlake.sources.manifest import SUCCESS

#: Runs up to here are sent to every executor (a few dozen bytes each); more are joined by shuffle.
MOST_BROADCAST_RUNS = 500_000


def build_t1(runs: DataFrame, obs: DataFrame, status: str = SUCCESS, n_runs: int | None = None) -> DataFrame:
    """``runs`` (run_id, location, status) left-joined with ``obs`` (run_id, valid_time, analysis_time, kindex).

    With a known, small number of runs the observations aren't shuffled: they meet the runs in place, and the runs
    that no observation names are added. That keeps a run with most of the rows from landing in one task.
    """
    good = runs.where(F.col("status") == status).select("run_id", "location")
    columns = ["location", "valid_time", "analysis_time", "kindex", "run_id"]
    if n_runs is None or n_runs > MOST_BROADCAST_RUNS:
        return good.join(obs, "run_id", "left").select(*columns)
    seen = obs.select("run_id").distinct()
    sentinels = good.join(seen, "run_id", "left_anti").select("location", *[F.lit(None).cast(obs.schema[c].dataType).alias(c) for c in columns[1:4]], "run_id")
    return obs.join(F.broadcast(good), "run_id").select(*columns).union(sentinels)


def observed(runs: DataFrame, obs: DataFrame, status: str = SUCCESS, n_runs: int | None = None) -> DataFrame:
    """T1's rows but for the sentinels, from one scan of ``obs``: who writes them adds a row for each run that turns out to have none."""
    good = runs.where(F.col("status") == status).select("run_id", "location")
    if n_runs is not None and n_runs <= MOST_BROADCAST_RUNS:
        good = F.broadcast(good)
    return obs.join(good, "run_id").select("location", "valid_time", "analysis_time", "kindex", "run_id")


def inner_runs(runs: DataFrame, obs: DataFrame) -> DataFrame:
    """Only runs that have observations."""
    return obs.join(runs.select("run_id", "location"), "run_id")


def unprocessed(runs: DataFrame, processed: DataFrame, status: str = SUCCESS) -> DataFrame:
    """Successful runs that T1 lacks."""
    return runs.where(F.col("status") == status).join(processed.select("run_id").distinct(), "run_id", "left_anti")


def oldest(runs: DataFrame) -> DataFrame:
    """One row: the smallest run_id, or empty text if there is none."""
    return runs.agg(F.coalesce(F.min("run_id"), F.lit("")).alias("run_id"))
