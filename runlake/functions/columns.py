"""Column expressions shared by readers, operators and queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from runlake.functions.timefmt import RUN_ID

RUN_IN_PATH = r".*/run_id=([^/]+)/.*"


def run_id_of(path: Column) -> Column:
    """The run in a file's path; empty if there is none."""
    return F.regexp_extract(path, RUN_IN_PATH, 1)


def sound_run_id(run_id: Column) -> Column:
    return run_id.rlike(RUN_ID)


def whole_number(text: Column, name: str) -> Column:
    """Text to int, halves to the even neighbour; text that isn't a number fails."""
    number = F.bround(text.try_cast("decimal(18,6)"), 0).cast("int")
    return F.when(text.isNull(), F.lit(None).cast("int")).otherwise(F.coalesce(number, F.raise_error(F.concat(F.lit(f"{name} is not a number: "), text)).cast("int")))


def count_null(name: str) -> Column:
    return F.coalesce(F.sum(F.col(name).isNull().cast("long")), F.lit(0).cast("long")).alias(name)
