"""One canonical observation per location and time, and audits of what led to it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ("location", "valid_time")


def build_t2(t1: DataFrame) -> DataFrame:
    """(location, valid_time, kindex, flag): the distinct values of the key's latest run; flag if the key ever had two.

    One shuffle on the key: maximum run, minimum and maximum value come from one window, and the final distinct reuses
    its partitioning. Rows without run_id never win but count for the flag; a null value of the latest run wins.
    """
    w = W.partitionBy(*KEY)
    rows = t1.where("valid_time is not null and location is not null").select(*KEY, "kindex", "run_id")
    told = rows.withColumn("latest", F.max("run_id").over(w)).withColumn("flag", F.coalesce(F.min("kindex").over(w) != F.max("kindex").over(w), F.lit(False)))
    return told.where("run_id = latest").select(*KEY, "kindex", "flag").distinct()


def build_t2_by_join(t1: DataFrame) -> DataFrame:
    """The same as group-by and self-join. Partial sums shrink a key with very many rows before the shuffle, where a window holds them all."""
    rows = t1.where("valid_time is not null").select(*KEY, "kindex", "run_id")
    keys = rows.groupBy(*KEY).agg(F.max("run_id").alias("latest"), F.coalesce(F.min("kindex") != F.max("kindex"), F.lit(False)).alias("flag"))
    values = rows.distinct()
    on = [values[k] == keys[k] for k in KEY] + [values["run_id"] == keys["latest"]]
    return values.join(keys, on).select(values["location"], values["valid_time"], "kindex", "flag").distinct()


def states(t1: DataFrame) -> DataFrame:
    """What T2 needs to know of each key, mergeable: (location, valid_time, latest, values, low, high).

    ``values`` are the distinct values of the latest run, null among them; low and high are the smallest and largest value of any run.
    Two aggregates, per key and run and then per key, both summed before their shuffle: a key with most of the rows shrinks to a row a run and task."""
    rows = t1.where("valid_time is not null and location is not null").select(*KEY, "kindex", "run_id")
    seen = rows.groupBy(*KEY, "run_id").agg(F.collect_set("kindex").alias("seen"), F.max(F.col("kindex").isNull()).alias("none"), F.min("kindex").alias("low"), F.max("kindex").alias("high"))
    values = F.when(F.col("none"), F.array_append("seen", F.lit(None).cast("int"))).otherwise(F.col("seen"))
    return merged(seen.select(*KEY, F.col("run_id").alias("latest"), F.array_sort(values).alias("values"), "low", "high"))


def merged(some: DataFrame) -> DataFrame:
    """States of different runs, in any order and number, to one for each key. Those without a run id count for the flag only."""
    return some.groupBy(*KEY).agg(F.max("latest").alias("latest"), F.max_by("values", "latest").alias("values"), F.min("low").alias("low"), F.max("high").alias("high"))


def told(some: DataFrame) -> DataFrame:
    """T2's rows from states of keys; no shuffle."""
    flag = F.coalesce(F.col("low") != F.col("high"), F.lit(False)).alias("flag")
    return some.where("latest is not null").select(*KEY, F.explode("values").alias("kindex"), flag)


def consolidated(t1: DataFrame) -> DataFrame:
    """T2 by one mergeable aggregate: one scan, no window, no join, and no form to choose by the data."""
    return told(states(t1))


def latest_runs(t1: DataFrame) -> DataFrame:
    return t1.where("valid_time is not null").groupBy(*KEY).agg(F.max("run_id").alias("latest_run_id"))


def disagreements(t1: DataFrame) -> DataFrame:
    return t1.where("valid_time is not null").groupBy(*KEY).agg(F.countDistinct("kindex").alias("n_values"), (F.countDistinct("kindex") > 1).alias("flag"))


def several_runs(t1: DataFrame) -> DataFrame:
    """Keys that several runs observed, with the number of runs and of calculation times."""
    counted = t1.groupBy(*KEY).agg(F.countDistinct("run_id").alias("n_runs"), F.countDistinct("analysis_time").alias("n_analysis_times"))
    return counted.where("n_runs > 1")


def sentinels(t1: DataFrame) -> DataFrame:
    return t1.where("valid_time is null")


def duplicate_keys(t2: DataFrame) -> DataFrame:
    """Keys with more than one row: what the uniqueness audit reports."""
    return t2.groupBy(*KEY).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def suspicious_runs(t1: DataFrame, sound) -> DataFrame:
    """Distinct run ids that aren't shaped like times."""
    return t1.where("run_id is not null").select("run_id").distinct().where(~sound(F.col("run_id")))
