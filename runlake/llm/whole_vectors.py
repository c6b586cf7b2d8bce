"""Whole-number vectors: exact squared distances and means, for clustering whose result must not depend on rounding.

Components are floor(scale * x). Distances, sums and comparisons are int64; ``most_component`` is the size up to
which a squared distance, and four times a component's share of it, can't overflow. Vectors beyond it take no part.

A pass over the vectors is one Spark job: each task assigns its rows, writes them with their new code, and adds one
row that holds its sums. Both are one task's output, so a lost task is repeated with its sums, and a round needs
no second scan. The sums are added up by Spark; only totals, whose size doesn't depend on the rows, reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from runlake.llm import common


def most_component(n: int) -> int:
    """The largest component of vectors of length ``n``: then n * (2 * it)^2 is below 2^63."""
    return math.isqrt((2**63 - 1) // (4 * max(1, n)))


def sound(embeddings: DataFrame, scale: int, length: int | None = None, multiple_of: int = 1, keep: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """(vec_id, v, keep...) of the rows that take part, and their length: no null or non-finite component, none too large.

    Without ``length`` it is the commonest one that is a multiple of ``multiple_of`` (of equally common ones the smallest)."""
    rows = embeddings.where("embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"), *keep)
    rows = rows.where((F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    if length is None:
        fits = rows.where(F.size("v") % multiple_of == 0)
        found = fits.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
        length = found[0].n if found else 0
    most = float(most_component(length) - 1)
    return rows.where((F.size("v") == length) & F.forall("v", lambda x: F.abs(x.cast("double")) * scale <= most)), length


def whole(column: pa.Array, scale: int) -> np.ndarray:
    """A column of equally long lists without nulls as int64 rows of floor(scale * x)."""
    flat = np.floor(np.asarray(column.flatten(), np.float64) * scale).astype(np.int64)
    return flat.reshape(len(column), -1)


def seeds(rows: DataFrame, order: list, n: int, scale: int) -> np.ndarray:
    """The first ``n`` rows' vectors in this order; rows alike in it go by their vectors."""
    first = rows.orderBy(*order, "v").limit(n).select("v").collect()
    return np.array([[math.floor(scale * x) for x in r.v] for r in first], np.int64)


def square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances, row by row."""
    d = a - b
    return np.einsum("ij,ij->i", d, d)


def neighbours(centres: np.ndarray, within: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each centre the others, nearest first, and a quarter of their squared distances, rounded up.

    If y is as near to x as centre a is, then |a - y| <= 2 |x - a|, so the quarter is at most |x - a|^2: exact in whole
    numbers, ties included. Beyond ``within[a]`` (a bound of |x - a|^2 for all x of a) neighbours are marked as out of reach."""
    k = len(centres)
    order, reach = np.zeros((k, max(0, k - 1)), np.int64), np.full((k, max(0, k - 1)), np.iinfo(np.int64).max)
    for a in range(k):
        quarter = (square(centres, centres[a]) + 3) // 4
        others = [j for j in np.lexsort((np.arange(k), quarter)).tolist() if j != a]
        for at, j in enumerate(others):
            order[a, at] = j
            if within is None or int(quarter[j]) <= within[a]:
                reach[a, at] = quarter[j]
    return order, reach


def nearest(x: np.ndarray, centres: np.ndarray, start: np.ndarray, near: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """(centre, squared distance) of the centre nearest to each row, ties to the smaller number, and how many distances were computed.

    From each row's ``start`` only the neighbours within twice its distance are compared, in order of nearness."""
    order, reach = near
    own, best = start.copy(), square(x, centres[start])
    todo = (reach[start] <= best[:, None]).sum(axis=1)
    rows, step, computed = np.flatnonzero(todo), 0, len(x)
    while len(rows):
        j = order[start[rows], step]
        d = square(x[rows], centres[j])
        computed += len(rows)
        better = (d < best[rows]) | ((d == best[rows]) & (j < own[rows]))
        own[rows[better]], best[rows[better]] = j[better], d[better]
        step += 1
        rows = rows[todo[rows] > step]
    return own, best, computed


def means(sums: np.ndarray, counts: np.ndarray, before: np.ndarray) -> np.ndarray:
    """floor(sum / count) for each centre; one without rows stays as it is."""
    used = counts > 0
    return np.where(used[:, None], sums // np.where(used, counts, 1)[:, None], before)


@dataclass
class Step:
    """What one pass does with a block of rows: new codes, errors, and what it adds to the task's sums and maxima."""

    codes: np.ndarray
    errors: np.ndarray
    sums: np.ndarray
    most: np.ndarray


#: (vectors as int64 rows, codes of the pass before or None) to a Step.
Assign = Callable[[np.ndarray, np.ndarray | None], Step]


def run_pass(rows: DataFrame, assign: Assign, scale: int, keep: tuple[str, ...], name: str) -> DataFrame:
    """One pass over ``rows`` (from ``sound`` or of the pass before), written: vec_id, keep..., whole, code, error, and the tasks' rows with sums and most."""
    first = "v" in rows.columns
    source = rows.select("vec_id", *keep, "v") if first else rows.where("whole is not null").select("vec_id", *keep, "whole", "code")
    kept = [source.schema[c] for c in ("vec_id", *keep)]
    longs = ArrayType(LongType())
    schema = StructType([*kept, StructField("whole", BinaryType()), StructField("code", BinaryType()), StructField("error", LongType()), StructField("sums", longs), StructField("most", longs)])
    n_kept, names = len(kept), schema.names

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = most = types = None
        longs = pa.list_(pa.int64())
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = whole(batch.column(n_kept), scale) if first else np.frombuffer(b"".join(batch.column(n_kept).to_pylist()), "<i4").reshape(n, -1).astype(np.int64)
            before = None if first else np.frombuffer(b"".join(batch.column(n_kept + 1).to_pylist()), np.uint8).reshape(n, -1)
            step = assign(x, before)
            sums = step.sums if sums is None else sums + step.sums
            most = step.most if most is None else np.maximum(most, step.most)
            types = [c.type for c in batch.columns[:n_kept]]
            body = pa.array([r.tobytes() for r in x.astype("<i4")], pa.binary()) if first else batch.column(n_kept)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_kept], body, pa.array([r.tobytes() for r in step.codes.astype(np.uint8)], pa.binary()), pa.array(step.errors), pa.nulls(n, longs), pa.nulls(n, longs)], names)
        if sums is not None:
            yield pa.RecordBatch.from_arrays([*[pa.nulls(1, t) for t in types], pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.array([sums.tolist()], longs), pa.array([most.tolist()], longs)], names)

    return common.materialise(rows.sparkSession, common.map_arrow(source, work, schema), name)


def totals(done: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The tasks' sums added up and the largest of their maxima, as Python's whole numbers would be."""
    out = []
    for column, how in (("sums", F.sum), ("most", F.max)):
        told = done.where(F.col(column).isNotNull()).select(F.posexplode(column)).groupBy("pos").agg(how("col").alias("x")).collect()  # a row a slot
        values = np.zeros(len(told), np.int64)
        for r in told:
            values[r.pos] = r.x
        out.append(values)
    return out[0], out[1]


def add_by(own: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the rows of each of ``k`` centres, and how many there are."""
    sums = np.zeros((k, x.shape[1]), np.int64)
    np.add.at(sums, own, x)
    return sums, np.bincount(own, minlength=k).astype(np.int64)
