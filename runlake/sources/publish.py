"""Writers: staged beside the target, then swapped in, so readers see the old table or the new one; T1's partitions are entered in its ledger."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from runlake import schemas
from runlake.sources.files import Files
from runlake.sources.ledger import Ledger, new_epoch


TRIES, PAUSE = 3, 0.2  #: seconds between them


def patiently(step: Callable[[], None], sleep: Callable[[float], None] | None = None) -> None:
    """A deletion or a move that another reader of the folder may hold up: tried ``TRIES`` times in all, then raised."""
    for left in reversed(range(TRIES)):
        try:
            return step()
        except Exception:
            if not left:
                raise
            (sleep or time.sleep)(PAUSE)


def swap(files: Files, staged: str, target: str) -> None:
    """Put ``staged`` in ``target``'s place. The old table is moved aside first and comes back if that fails."""
    aside = f"{target}.{uuid.uuid4().hex}.old"
    had = files.exists(target)
    if had:
        patiently(lambda: files.move(target, aside))
    try:
        patiently(lambda: files.move(staged, target))
    except Exception:
        if had and not files.exists(target):
            files.move(aside, target)
        raise
    if had:
        patiently(lambda: files.delete(aside))


def staging(target: str) -> str:
    return f"{target.rstrip('/')}.{uuid.uuid4().hex}.staging"


def tidy(files: Files, folder: str) -> None:
    """Drop what Spark's committer leaves beside the data."""
    for name, is_folder, _ in files.names(folder):
        if not is_folder and (name == "_SUCCESS" or name.endswith(".crc")):
            files.delete(f"{folder}/{name}")


def leaves(files: Files, folder: str, depth: int) -> list[str]:
    """The partitions below a folder, as relative paths ``key=value/...``, sorted."""
    found = [""]
    for _ in range(depth):
        found = [f"{at}{name}/" for at in found for name, is_folder, _ in files.names(f"{folder}/{at}".rstrip("/")) if is_folder and "=" in name]
    return [at.rstrip("/") for at in found]


def adopted(files: Files, path: str, depth: int) -> dict[str, dict]:
    """What the ledger is told first of a table that was there before it: its epoch, and the partitions that hold Parquet files."""
    return {"": {"epoch": new_epoch()}} | {at: {} for at in leaves(files, path, depth) if any(n.endswith(".parquet") for n, _, _ in files.names(f"{path}/{at}"))}


def commit(spark: SparkSession, staged: str, path: str, depth: int) -> list[str]:
    """Put the partitions of ``staged`` into the table, each by one rename, and then tell the ledger. Returns them.

    Until the ledger has them they count as missing: an append that is killed between is done again, and no reader sees part of a
    partition. One that is replaced is moved aside first; a partition that the ledger has and the table hasn't counts as missing too."""
    files, ledger = Files(spark), Ledger(spark, path)
    state, parts = ledger.state(), leaves(files, staged, depth)
    if not state.version:
        ledger.append(adopted(files, path, depth))
        state = ledger.state()
    aside = f"{path}/_old-{uuid.uuid4().hex}"
    for at in parts:
        target = f"{path}/{at}"
        if files.exists(target):
            files.make(f"{aside}/{at}".rpartition("/")[0])
            patiently(lambda: files.move(target, f"{aside}/{at}"))  # noqa: B023  called at once
        files.make(target.rpartition("/")[0])
        patiently(lambda: files.move(f"{staged}/{at}", target))  # noqa: B023
    ledger.append({at: {"again": True} if at in state.values else {} for at in parts})
    files.delete(aside)
    return parts


def drop_leftovers(files: Files, path: str) -> None:
    """Delete what appends that were killed have left in the table's folder; only while no other append runs."""
    for name, is_folder, _ in files.names(path):
        if is_folder and name.startswith(("_staging-", "_old-")):
            files.delete(f"{path}/{name}")


def with_sentinels(spark: SparkSession, staged: str, runs: list[tuple[str, str]], schema: StructType) -> None:
    """One row with nothing but (run_id, location) for each of the runs that has no folder in ``staged``: known from the folders, no data is read."""
    seen = {unescaped(spark, at.partition("=")[2]) for at in leaves(Files(spark), staged, 1)}
    missing = [{"run_id": run_id, "location": location} for run_id, location in runs if run_id not in seen]
    if missing:
        rows = spark.createDataFrame([tuple(m.get(c) for c in schema.names) for m in missing], schema)
        rows.coalesce(1 + len(missing) // 1_000).write.mode("append").partitionBy("run_id").parquet(staged)


def unescaped(spark: SparkSession, value: str) -> str:
    """A partition's value from its folder's name."""
    return spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(value) if "%" in value else value


def write_t1(df: DataFrame, path: str, mode: str = "append", partition_by: tuple[str, ...] = ("run_id",), runs: list[tuple[str, str]] = ()) -> str:
    """Append replaces the partitions that ``df`` has and leaves the others, so a repeated append doesn't double a run; overwrite replaces the table.

    Both write beside the table first. ``runs`` (run_id, location): those that ``df`` has no row of get a sentinel row, without ``df`` being made twice."""
    if mode not in ("append", "overwrite"):
        raise ValueError(f"mode is append or overwrite, not {mode!r}")
    if not partition_by:
        raise ValueError("T1 needs partition columns")
    spark = df.sparkSession
    files, path = Files(spark), path.rstrip("/")
    staged = staging(path) if mode == "overwrite" else f"{path}/_staging-{uuid.uuid4().hex}"
    try:
        df.write.partitionBy(*partition_by).parquet(staged)
        if runs:
            with_sentinels(spark, staged, runs, schemas.T1)
        if mode == "append":
            commit(spark, staged, path, len(partition_by))
        else:
            Ledger(spark, staged).append(adopted(files, staged, len(partition_by)))
            swap(files, staged, path)
    finally:
        files.delete(staged)
        if mode == "append" and not files.names(path):
            files.delete(path)  # the first append failed
    return path


def write_t2(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> str:
    """Always replaces the table: one file ``T2.parquet``, or folders by the partition columns. Returns the folder."""
    files = Files(df.sparkSession)
    path = path.rstrip("/")
    staged = staging(path)
    try:
        if partition_by:
            df.write.partitionBy(*partition_by).parquet(staged)
        else:
            df.repartition(1).write.parquet(staged)  # one file is the table's contract; what makes the rows keeps its tasks
            parts = [n for n, folder, _ in files.names(staged) if not folder and n.endswith(".parquet")]
            files.move(f"{staged}/{parts[0]}", f"{staged}/T2.parquet")
        tidy(files, staged)
        swap(files, staged, path)
    finally:
        files.delete(staged)
    return path


def single_file(df: DataFrame, target: str) -> str:
    """``df`` as one Parquet file of this very name."""
    files, staged = Files(df.sparkSession), staging(target)
    try:
        df.repartition(1).write.parquet(staged)
        part = next(n for n, folder, _ in files.names(staged) if not folder and n.endswith(".parquet"))
        files.move(f"{staged}/{part}", target)
    finally:
        files.delete(staged)
    return target


def drop_table(spark: SparkSession, path: str) -> None:
    Files(spark).delete(path)
