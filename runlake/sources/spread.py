"""Many small files of a lake, listed, read and written by Spark's tasks instead of the driver.

Spark's own readers skip names that begin with ``_``, as those of manifests and markers do, so tasks use pyarrow's file systems: local
folders, HDFS and the object stores below, with the credentials that the workers' surroundings give (Hadoop's settings don't reach
Python workers). ``reached`` says whether that works for a lake; where it doesn't, callers read through ``files`` on the driver.

The driver lists the folders above the runs', in one call each. Tasks take ``AT_ONCE`` run folders each, of many folders a hundredth, ``MOST`` at
most, so that neither tasks nor their number cost more than the files. They look into ``READERS`` folders at a time (on local disks, where threads cost
more than they save, into one) and hold their files, and rows of ``HELD`` bytes' files or ``LINES`` rows, no more. A folder that has gone since gives no rows.

Spark's writers take a folder a key too, but their committer moves what they wrote once more, on the driver, a folder or file after the other.
``write_lines`` has each task put its files in their places. Lines go from Arrow's memory into a file as they lie there, many at once.
"""

from __future__ import annotations

import fnmatch
import itertools
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from runlake.session import ship
from runlake.sources.files import Files

AT_ONCE, MOST, READERS = 200, 2_000, 8
LINES = 4_096  #: rows of files that are being read or written, held at once
HELD = 1 << 20
_ARROW = {"string": pa.string(), "bigint": pa.int64()}

LOCAL = ("", "file")
#: What pyarrow calls the stores of these Hadoop schemes.
SCHEMES = {"hdfs": "hdfs", "viewfs": "viewfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss"}


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a qualified path, and the path in it. Names are taken as they are: a ``%`` in them is no escape."""
    parts = urlsplit(uri)
    if parts.scheme in LOCAL:
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    if parts.scheme not in SCHEMES:
        raise ValueError(f"no tasks read from {parts.scheme}")
    system, base = fs.FileSystem.from_uri(f"{SCHEMES[parts.scheme]}://{parts.netloc}/")
    return system, f"{base.rstrip('/')}/{uri.partition('://')[2].partition('/')[2]}"


def reached(spark: SparkSession, uri: str) -> str | None:
    """The path, qualified, if Python can look at that folder; else None."""
    files = Files(spark)
    whole = files.system(uri).makeQualified(files.path(uri)).toString()
    try:
        system, path = store(whole)
        return whole if system.get_file_info(path).type == fs.FileType.Directory else None
    except (ValueError, OSError, pa.ArrowException):
        return None


def _within(system: fs.FileSystem, path: str) -> list[fs.FileInfo]:
    return system.get_file_info(fs.FileSelector(path, allow_not_found=True))


def run_folders(root: str) -> list[str]:
    """The run folders below, at any depth, but none within another; sorted."""
    (system, top), found, todo = store(root), [], [""]
    while todo:
        at = todo.pop()
        for info in _within(system, top.rstrip("/") + at):
            if info.type == fs.FileType.Directory:
                (found if info.base_name.startswith("run_id=") else todo).append(f"{at}/{info.base_name}")
    return sorted(root.rstrip("/") + f for f in found)


def run_names(table: str) -> list[str]:
    """The names of the run folders that lie directly in a table's folder."""
    system, path = store(table)
    return [i.base_name for i in _within(system, path) if i.type == fs.FileType.Directory and i.base_name.startswith("run_id=")]


def for_files(spark: SparkSession, folders: list[str], patterns: tuple[str, ...], make: Callable[[str, str, int, bytes | None], tuple], schema: str, content: bool = True) -> DataFrame:
    """A row ``make(folder, name, bytes, content)`` for each file that lies directly in one of the folders and fits one of the patterns."""
    ship(spark)
    names = spark.createDataFrame(pa.table({"folder": pa.array(folders, pa.string())}), "folder string")
    fields = StructType.fromDDL(schema)
    labels, types = fields.names, [_ARROW[f.dataType.simpleString()] for f in fields]

    def look(folder: str) -> tuple[list[tuple], int]:
        system, path = store(folder)
        out, size = [], 0
        for info in _within(system, path):
            if info.type == fs.FileType.File and any(fnmatch.fnmatchcase(info.base_name, p) for p in patterns):
                held = None
                if content:
                    with system.open_input_stream(info.path) as stream:
                        held = stream.read()
                    size += len(held)
                out.append(make(folder, info.base_name, info.size, held))
        return out, size

    def looked(own: list[str], readers: ThreadPoolExecutor) -> Iterator[tuple[list[tuple], int]]:
        for at in range(0, len(own), READERS):
            some = own[at : at + READERS]
            local = all(urlsplit(folder).scheme in LOCAL for folder in some)
            yield from (map if local else readers.map)(look, some)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=labels)

        rows, held = [], 0
        with ThreadPoolExecutor(READERS) as readers:
            for batch in batches:
                for found, size in looked(batch.column(0).to_pylist(), readers):
                    rows += found
                    held += size
                    if held >= HELD or len(rows) >= LINES:
                        yield told()
                        rows, held = [], 0
        yield told()

    at_once = min(MOST, max(AT_ONCE, len(folders) // 100))
    return names.repartition(max(1, -(-len(folders) // at_once)), "folder").mapInArrow(run, fields)


def listed(spark: SparkSession, folders: list[str], patterns: tuple[str, ...] = ("*",)) -> DataFrame:
    """(folder, name, bytes) of the files that fit; nothing is opened."""
    return for_files(spark, folders, patterns, lambda folder, name, size, _: (folder, name, size), "folder string, name string, bytes long", content=False)


def texts(spark: SparkSession, folders: list[str], patterns: tuple[str, ...]) -> DataFrame:
    """(folder, name, content) of the files that fit; what isn't UTF-8 fails."""
    return for_files(spark, folders, patterns, lambda folder, name, _, held: (folder, name, held.decode()), "folder string, name string, content string")


def strict(rows: DataFrame, fault: str) -> DataFrame:
    """The rows without the column ``fault``; reading one in which it isn't null fails with what it says."""
    return rows.where(F.when(F.col(fault).isNull(), F.lit(True)).otherwise(F.raise_error(F.col(fault)).cast("boolean"))).drop(fault)


def _stretches(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, str, pa.Buffer]]:
    """Sorted rows (folder, name, line) as (folder, name, lines, each ended) of rows that follow each other in one file, up to ``LINES`` at once."""
    for batch in (b.slice(at, LINES) for b in batches for at in range(0, b.num_rows, LINES)):
        folder, name, line = batch.columns
        if folder.null_count or name.null_count:
            raise ValueError("a file without a name")
        if line.null_count:
            raise ValueError("a line of NoneType")
        ended = pc.binary_join_element_wise(line, pa.scalar("", line.type), pa.scalar("\n", line.type))
        kind = np.int64 if pa.types.is_large_string(line.type) else np.int32
        ends = np.frombuffer(ended.buffers()[1], kind)[ended.offset : ended.offset + len(ended) + 1].tolist()
        new = pc.or_(pc.not_equal(folder[1:], folder[:-1]), pc.not_equal(name[1:], name[:-1]))
        starts = [0, *(np.flatnonzero(new.to_numpy(zero_copy_only=False)) + 1).tolist()]
        for a, b in itertools.pairwise([*starts, len(ended)]):
            yield folder[a].as_py(), name[a].as_py(), ended.buffers()[2].slice(ends[a], ends[b] - ends[a])


def _put(system: fs.FileSystem, path: str, name: str, pieces: Iterable[pa.Buffer]) -> None:
    """A file, whole or not at all: written beside, then moved over."""
    beside = f"{path}/.{name}.{uuid.uuid4().hex}.tmp"
    try:
        with system.open_output_stream(beside) as stream:
            for piece in pieces:
                stream.write(piece)
        system.move(beside, f"{path}/{name}")
    except BaseException:
        if system.get_file_info(beside).type == fs.FileType.File:
            system.delete_file(beside)
        raise


def write_lines(spark: SparkSession, rows: DataFrame, root: str) -> int:
    """The files ``folder/name`` below ``root`` with the lines of ``rows`` (folder, name, line: text, none null), in any order; how many.

    One task writes all of a folder's files, each from its sorted rows as they come, so a file may be of any size. A file that is there is replaced, so a
    task that runs again leaves the same. Files appear one by one: who needs all or none looks at the lake after this has returned."""
    ship(spark)
    Files(spark).make(root)
    whole = reached(spark, root)
    if whole is None:
        raise ValueError(f"no tasks write to {root}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (system, top), at, files = store(whole), None, 0
        for (folder, name), own in itertools.groupby(_stretches(batches), key=lambda row: row[:2]):
            path = f"{top.rstrip('/')}/{folder}"
            if folder != at:
                system.create_dir(path)
                at = folder
            _put(system, path, name, (piece for _, _, piece in own))
            files += 1
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], names=["files"])

    ordered = rows.select("folder", "name", "line").repartition("folder").sortWithinPartitions("folder", "name")
    return ordered.mapInArrow(run, "files long").agg(F.coalesce(F.sum("files"), F.lit(0))).first()[0]
