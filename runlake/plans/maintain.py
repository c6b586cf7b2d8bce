"""T2 kept up to date run by run: only what new runs touch is read and written.

Beside T1 lies a table of states, one for each key (``canonical.states``), in folders by the month of ``valid_time``. Refreshing it
reads the partitions of T1 that came since, merges their states with those of the months that they touch, writes these months
anew and enters them in the table's ledger, together with how far T1's ledger has been read: one entry, so a refresh that is killed has not
happened. T2 is read from the states without a shuffle.

Merging knows a run once. A T1 that was rebuilt, or a run in it that was appended again, makes the next refresh start over from all of T1.
"""

from __future__ import annotations

import logging
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from runlake import schemas
from runlake.operators import canonical
from runlake.sources.files import Files
from runlake.sources.ledger import Ledger, State
from runlake.sources.publish import leaves, patiently

log = logging.getLogger(__name__)

STATE = StructType([*(schemas.T2[c] for c in canonical.KEY), StructField("latest", StringType()), StructField("values", ArrayType(IntegerType())), StructField("low", IntegerType()), StructField("high", IntegerType())])
READ, OLD = "", "old"  #: the ledger's keys for how far T1 was read, and for folders that no longer count


def _due(theirs: State, mine: State) -> tuple[bool, list[str]]:
    """Whether to start over, and the partitions of T1 to read."""
    read = mine.values.get(READ)
    epoch = theirs.values.get("", {}).get("epoch")
    parts = {at: theirs.since[at] for at in theirs.values if at}
    if read and read["epoch"] == epoch:
        new = [at for at, number in parts.items() if number > read["version"]]
        if not any(theirs.values[at].get("again") for at in new):
            return False, sorted(new)
    return True, sorted(parts)


def refresh(spark: SparkSession, t1: str, states: str) -> int:
    """Bring the states up to T1's ledger; how many of its partitions were read."""
    files, own = Files(spark), Ledger(spark, states)
    theirs, mine = Ledger(spark, t1).state(), own.state()
    anew, due = _due(theirs, mine)
    upto = {"epoch": theirs.values.get("", {}).get("epoch"), "version": theirs.version}
    if mine.version and mine.values[READ] == upto:
        return 0
    log.info("%s: %s runs to merge%s", states, len(due), ", all again" if anew and mine.version else "")
    scratch = f"{states.rstrip('/')}/_new-{uuid.uuid4().hex}"
    held = {at: where for at, where in mine.values.items() if at not in (READ, OLD)}
    try:
        touched: dict[str, str] = {}
        if due:
            month = F.date_format("valid_time", "yyyy-MM").alias("month")
            rows = spark.read.schema(schemas.T1).option("basePath", t1).parquet(*[f"{t1.rstrip('/')}/{at}" for at in due])
            canonical.states(rows).select("*", month).write.partitionBy("month").parquet(f"{scratch}/seen")
            months = leaves(files, f"{scratch}/seen", 1)
            before = [] if anew else [f"{states.rstrip('/')}/{held[m]}" for m in months if m in held]
            source = "seen"
            if before:
                both = spark.read.schema(STATE).parquet(f"{scratch}/seen").select(*STATE.names).unionByName(spark.read.schema(STATE).parquet(*before))
                canonical.merged(both).select("*", month).write.partitionBy("month").parquet(f"{scratch}/merged")
                source = "merged"
            for m in months:
                touched[m] = f"{m}/{uuid.uuid4().hex}"
                files.make(f"{states.rstrip('/')}/{m}")
                patiently(lambda: files.move(f"{scratch}/{source}/{m}", f"{states.rstrip('/')}/{touched[m]}"))  # noqa: B023  called at once
        dropped = {m: None for m in held if m not in touched} if anew else {}
        gone = [held[m] for m in (*touched, *dropped) if m in held]
        own.append({READ: upto, OLD: gone} | touched | dropped, expected=mine.version)
        for folder in mine.values.get(OLD) or []:  # replaced by the refresh before: readers have had until now
            files.delete(f"{states.rstrip('/')}/{folder}")
    finally:
        files.delete(scratch)
    return len(due)


def read_states(spark: SparkSession, states: str) -> DataFrame:
    folders = [f"{states.rstrip('/')}/{where}" for at, where in Ledger(spark, states).state().values.items() if at not in (READ, OLD)]
    return spark.read.schema(STATE).parquet(*folders) if folders else spark.createDataFrame([], STATE)


def read_t2(spark: SparkSession, states: str) -> DataFrame:
    """T2 as of the last refresh."""
    return canonical.told(read_states(spark, states))
