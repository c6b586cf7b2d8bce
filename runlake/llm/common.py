"""What the operators share: the shared folder, lineage cuts, skewed joins, shipping code, Arrow plumbing.

Lineage is cut by writing Parquet below the folder named by ``spark.checkpoint.dir`` (shared by
driver and executors), so that a lost executor costs a re-read and nothing else. A session that
names no such folder gets a temporary one if it runs on one machine, as in tests, and an error on a
cluster, where a machine-local folder would lose rows.
"""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_LOCAL_ROOT: list[str] = []
_MADE = threading.local()  # the places that fresh_uri gave out to this thread's queries, in order
#: Rows of an Arrow batch on its way to a Python worker, at most: buffers outside the heap grow with it.
BATCH_ROWS = 2_000


def _own_folder(prefix: str) -> str:
    """A temporary folder of this process, deleted when it ends."""
    folder = tempfile.mkdtemp(prefix=prefix)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_root(spark: SparkSession) -> str:
    """The URI below which intermediate tables go: ``spark.checkpoint.dir`` where it is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _LOCAL_ROOT:
            _LOCAL_ROOT.append("file://" + _own_folder("runlake-"))
        root = _LOCAL_ROOT[0]
    if "://" not in root and not root.startswith("file:"):
        root = "file://" + os.path.abspath(root)
    return root.rstrip("/")


def fresh_uri(spark: SparkSession, name: str) -> str:
    """A new place for a table of this application."""
    uri = f"{shared_root(spark)}/runlake/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    _places().append(uri)
    return uri


def _places() -> list[str]:
    if not hasattr(_MADE, "uris"):
        _MADE.uris = []
    return _MADE.uris


def made() -> int:
    """How many places this thread has been given so far, for ``tidy``."""
    return len(_places())


def tidy(spark: SparkSession, since: int, keep: DataFrame) -> None:
    """Delete the tables that this thread made after ``since`` but for ``keep``, when nothing else reads them any more. Queries that run meanwhile in other threads keep theirs."""
    left, own = getattr(keep, "_runlake_uri", None), _places()
    for uri in own[since:]:
        if uri != left:
            discard(spark, uri)
    own[since:] = [left] if left else []


def sweep(spark: SparkSession) -> None:
    """Delete all that this application has put into the shared folder; results that still read it must be written before."""
    discard(spark, f"{shared_root(spark)}/runlake/{spark.sparkContext.applicationId}")


def materialise(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later plans start from the files."""
    uri = fresh_uri(spark, name)
    df.write.parquet(uri)
    out = spark.read.schema(df.schema).parquet(uri)
    out._runlake_uri = uri  # for discard()
    return out


def discard(spark: SparkSession, df: DataFrame | str | None) -> None:
    """Delete a materialised table that no live plan reads any more."""
    uri = df if isinstance(df, str) else getattr(df, "_runlake_uri", None)
    if uri:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that they need no installed copy."""
    sc = spark.sparkContext
    if getattr(sc, "_runlake_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if os.path.isdir(package):  # else it was imported from a zip that is on the path already
        body = io.BytesIO()
        with zipfile.ZipFile(body, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(package):
                for name in sorted(names):
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.relpath(full, os.path.dirname(package)))
        target = os.path.join(_own_folder("runlake-ship-"), "runlake_pkg.zip")  # Spark serves it from here to the executors
        with open(target, "wb") as f:
            f.write(body.getvalue())
        sc.addPyFile(target)
    sc._runlake_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """``mapInArrow`` after shipping the package; the session's Arrow batches are kept to ``BATCH_ROWS``."""
    spark = df.sparkSession
    ship(spark)
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return df.mapInArrow(fn, schema)


def spare(columns: list[str], *names: str) -> list[str]:
    """Working names after ``names`` that no column has, whatever its case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def join_skewed(many: DataFrame, one: DataFrame, key: str, rows: str, parts: int = 1_000) -> DataFrame:
    """Inner join of ``many`` with ``one`` on ``key``, which ``one`` holds once and not null, with the number of ``many``'s rows in column ``rows``.

    Keys with over 1/``parts`` of all rows are broadcast: there are fewer than ``parts`` of them. The
    rest is joined by a shuffle, in which no key is large. Both tables are read twice."""
    total = one.agg(F.sum(rows)).first()[0] or 0
    heavy = F.broadcast(one.where(F.col(rows) * parts > total).drop(rows))
    light = one.where(F.col(rows) * parts <= total).drop(rows)
    return many.join(heavy, key).unionByName(many.join(heavy.select(key), key, "left_anti").join(light, key))


def slices(batches: Iterator[pa.RecordBatch], text: str | None = "text", most_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that no piece holds much more than ``most_bytes`` of text: long documents never pile up."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        step = batch.num_rows
        if text is not None:
            column = batch.column(batch.schema.get_field_index(text))
            step = max(1, int(batch.num_rows * most_bytes / max(1, column.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def lower_ascii(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased and nothing else touched; null is empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass").lower()
