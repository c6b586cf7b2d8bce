"""The driver's ``events`` seen as tabulated observations, so that every operator has whole tables to run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlake.functions.timefmt import hour_column

STATUSES = ("SUCCESS", "SUCCESS", "SUCCESS", "FAILED", "RUNNING", "SUCCESS", "SUCCESS")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_id(n) -> F.Column:
    return F.concat(F.lit("20240201T00000"), n.cast("string"), F.lit("Z"))


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1's columns: repeated keys, disagreeing and null values, sentinels, conflicts within a run."""
    e = read(spark, sf_dir, "events")
    return e.select(
        F.col("event_type").alias("location"),
        F.when(F.col("event_id") % 97 != 0, hour_column(F.col("ts"))).alias("valid_time"),
        F.col("ts").cast("timestamp_ntz").alias("analysis_time"),
        F.when(F.col("event_id") % 31 != 0, F.floor("value").cast("int") % 10).alias("kindex"),
        run_id(F.col("user_id") % 5).alias("run_id"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, location, status): seven runs, of which two are successful and have no observations."""
    n = read(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("n")).distinct()
    statuses = F.array(*[F.lit(s) for s in STATUSES])
    return n.select(run_id(F.col("n")).alias("run_id"), F.concat(F.lit("site"), F.col("n").cast("string")).alias("location"), F.get(statuses, F.col("n").cast("int")).alias("status"))


OBS_SQL = """obs AS (SELECT event_type AS location, CASE WHEN event_id % 97 <> 0 THEN date_trunc('hour', ts) END AS valid_time, ts AS analysis_time,
  CASE WHEN event_id % 31 <> 0 THEN CAST(floor(value) AS INTEGER) % 10 END AS kindex, '20240201T00000' || CAST(user_id % 5 AS VARCHAR) || 'Z' AS run_id FROM events)"""

RUNS_SQL = """runs AS (SELECT '20240201T00000' || CAST(n AS VARCHAR) || 'Z' AS run_id, 'site' || CAST(n AS VARCHAR) AS location,
  CASE WHEN n IN (0, 1, 2, 5, 6) THEN 'SUCCESS' WHEN n = 3 THEN 'FAILED' ELSE 'RUNNING' END AS status FROM (SELECT DISTINCT user_id % 7 AS n FROM events))"""

T2_SQL = """filtered AS (SELECT * FROM obs WHERE valid_time IS NOT NULL),
keys AS (SELECT location, valid_time, max(run_id) AS latest, count(DISTINCT kindex) > 1 AS flag FROM filtered GROUP BY location, valid_time),
t2 AS (SELECT DISTINCT f.location, f.valid_time, f.kindex, k.flag FROM filtered f JOIN keys k ON f.location = k.location AND f.valid_time = k.valid_time AND f.run_id = k.latest)"""
