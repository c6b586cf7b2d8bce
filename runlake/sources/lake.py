"""Readers of the lake's tables: raw observations, the run-partitioned table T1, the consolidated table T2."""

from __future__ import annotations

import fnmatch
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlake import schemas
from runlake.functions.columns import run_id_of, whole_number
from runlake.sources import publish, spread
from runlake.sources.files import Files
from runlake.sources.ledger import Ledger, State
from runlake.sources.manifest import READERS, SPREAD, Run, run_folders, run_in

CHUNKS = "*.jsonl"


def chunk_files(spark: SparkSession, run: Run, pattern: str = CHUNKS) -> list[str]:
    """The run's chunk files, sorted; unfinished ones (.tmp) don't fit the pattern."""
    return [f"{run.folder}/{name}" for name, folder, _ in Files(spark).names(run.folder) if not folder and fnmatch.fnmatch(name, pattern)]


def empty_observations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], schemas.OBSERVATIONS)


def with_chunks(spark: SparkSession, runs: list[Run], pattern: str = CHUNKS, spread_from: int = SPREAD) -> list[str]:
    """The folders of those runs that have a chunk with something in it. From ``spread_from`` runs on, tasks list them."""
    every = [r.folder for r in runs]
    if len(every) >= spread_from and all(spread.reached(spark, at) for at in every[:1]):
        found = spread.listed(spark, every, (pattern,)).where("bytes > 0").select("folder").distinct()
        return sorted(r.folder for r in found.collect())  # a folder a run
    files = Files(spark)
    with ThreadPoolExecutor(READERS) as readers:
        listed = list(readers.map(files.names, every))
    return [at for at, names in zip(every, listed, strict=True) if any(not folder and size and fnmatch.fnmatch(name, pattern) for name, folder, size in names)]


def observations(spark: SparkSession, runs: list[Run], pattern: str = CHUNKS) -> DataFrame:
    """(run_id, valid_time, analysis_time, kindex) of the runs' chunks; a typed empty table if they have none.

    Only folders of the given runs are read. Missing keys are null, others are dropped; malformed lines and
    values that can't be cast fail.
    """
    folders = with_chunks(spark, runs, pattern)
    if not folders:
        return empty_observations(spark)
    raw = spark.read.schema(schemas.RAW).option("mode", "FAILFAST").option("pathGlobFilter", pattern).json(folders)
    return raw.select(
        run_id_of(F.col("_metadata.file_path")).alias("run_id"),
        F.col("valid_time").cast("timestamp_ntz").alias("valid_time"),
        F.col("analysis_time").cast("timestamp_ntz").alias("analysis_time"),
        whole_number(F.col("index"), "index").alias("kindex"),
    )


def has_table(spark: SparkSession, path: str) -> bool:
    """A folder without Parquet files is no table; what lies in folders that begin with ``_`` is none of it."""
    files, todo = Files(spark), [path.rstrip("/")]
    while todo:
        at = todo.pop()
        for name, folder, _ in files.names(at):
            if not folder and name.endswith(".parquet"):
                return True
            if folder and not name.startswith("_"):
                todo.append(f"{at}/{name}")
    return False


def read_t1(spark: SparkSession, path: str) -> DataFrame:
    """With the declared schema, so that a run_id that looks like a number stays text."""
    return spark.read.schema(schemas.T1).parquet(path)


def read_t2(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def processed_run_ids(spark: SparkSession, path: str) -> set[str]:
    """The runs in T1: those that its ledger has and whose folder is there. One listing, a few small reads, no data. A table without a ledger goes by its folders."""
    reached = spread.reached(spark, path)
    names = spread.run_names(reached) if reached else [name for name, folder, _ in Files(spark).names(path) if folder and name.startswith("run_id=")]
    state = Ledger(spark, path).state() if names else State()
    done = [n for n in names if n in state.values] if state.version else [n for n in names if has_table(spark, f"{path}/{n}")]
    return {publish.unescaped(spark, n.partition("=")[2]) for n in done}


def markers(spark: SparkSession, raw: str) -> DataFrame:
    """(run_id, marker, content) of the runs' marker files, read by tasks where they reach the store, else on the driver, many at a time.
    They are for people: status is the manifest's."""
    reached = spread.reached(spark, raw)
    folders = run_folders(spark, raw, reached)
    if reached:
        found = spread.texts(spark, folders, ("_SUCCESS", "_FAILED"))
        return found.select(run_id_of(F.concat("folder", F.lit("/"))).alias("run_id"), F.col("name").alias("marker"), "content")
    files = Files(spark)
    with ThreadPoolExecutor(READERS) as readers:
        names = list(readers.map(files.names, folders))
        found = [(at, name) for at, own in zip(folders, names, strict=True) for name, folder, _ in own if not folder and name in ("_SUCCESS", "_FAILED")]
        texts = list(readers.map(lambda x: files.read(f"{x[0]}/{x[1]}"), found))
    rows = [(run_in(f"{at}/"), name, text) for (at, name), text in zip(found, texts, strict=True)]
    return spark.createDataFrame(rows, "run_id string, marker string, content string")
