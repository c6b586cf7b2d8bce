"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is a minimum per node (pre-aggregated before the shuffle) and an equi-join back, so a hub
with a third of all edges is split by Spark's skew join and never collected. Each round is written
to the shared folder, which cuts the lineage; rounds grow with the logarithm of the longest chain.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlake.llm import common

EDGES = "a long, b long"


class Forest:
    """Union-find with path halving; the root is the smallest member."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def stars(self) -> tuple[list[int], list[int]]:
        """(root, member) for every member but the roots."""
        pairs = [(self.find(x), x) for x in self.up]
        return [r for r, x in pairs if r != x], [x for r, x in pairs if r != x]


def thin(edges: DataFrame, most: int = 200_000) -> DataFrame:
    """Drop edges that others of the same partition imply; at most ``most`` nodes are held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()

        def out() -> pa.RecordBatch:
            a, b = forest.stars()
            return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                forest.join(a, b)
            if len(forest.up) > most:
                yield out()
                forest = Forest()
        yield out()

    return common.map_arrow(edges.select("a", "b"), run, EDGES)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: long, not null) to (node, root): every node of an edge with the smallest node of its component."""
    spark = edges.sparkSession
    now = common.materialise(spark, edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("m").alias("a"), "b").where("a < b").distinct()
        #: Now b is the larger end: hang it and its other smaller neighbours on the smallest of them.
        small = large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
        hung = large.join(small, F.col("b") == F.col("u")).select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a < b").distinct()
        after = common.materialise(spark, hung, "edges")
        common.discard(spark, now)
        now, before, state = after, state, _state(after)
        if state == before:
            break
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
