"""Centroid clustering by ball k-means in whole numbers.

A cluster is a ball: its centroid and a radius that no member exceeds. Before each round the balls that moved are
given new radii, the largest distance seen in the round before plus the centroid's own move (both rounded up), so that no extra scan is needed.
A ball's relevant neighbours are the centroids whose distance is at most twice its radius; no member can be nearer to any
other. A member nearer to its centroid than half the way to the nearest neighbour is in the stable core and stays. The rest
lies in annuli bounded by half the distances to the neighbours in turn: a member of the n-th is compared with the first n
neighbours, exactly. Squared distances are compared with quarters of squared distances, rounded up, in int64, so ties keep to the smaller number.

The first round has no balls and starts from centroid 0 with all others relevant. Empty clusters stay where they are.

Defined cases: vectors that are null, have another length than ``length``, or hold null or non-finite components take no part;
nor do those with a component beyond ``most_component`` (1.9e8 for 64 components), whose distance would overflow. Rows repeated
or tied in vec_id count each for itself; as first centroids rows tied in the hash go by vector, null vec_ids last. Fewer rows
than clusters make fewer clusters. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlake.llm import common, whole_vectors

LOW = np.int64((1 << 32) - 1)


@dataclass
class Balls:
    """centres[cluster]; within[cluster]: a bound of its members' squared distances, None before the first round. ``compared``: distances computed a round."""

    centres: np.ndarray
    within: list[int] | None = None
    compared: list[int] = field(default_factory=list)
    inertia: list[int] = field(default_factory=list)

    def assigner(self) -> whole_vectors.Assign:
        centres, k = self.centres, len(self.centres)
        near = whole_vectors.neighbours(centres, self.within)

        def assign(x: np.ndarray, before: np.ndarray | None) -> whole_vectors.Step:
            start = np.zeros(len(x), np.int64) if before is None else before[:, 0].astype(np.int64)
            own, best, computed = whole_vectors.nearest(x, centres, start, near)
            sums, counts = whole_vectors.add_by(own, x, k)
            halves, _ = whole_vectors.add_by(own, np.stack([best >> 32, best & LOW], axis=1), k)  # so that sums of distances can't overflow
            far = np.zeros(k, np.int64)
            np.maximum.at(far, own, best)
            return whole_vectors.Step(own[:, None], best, np.concatenate([sums.ravel(), counts, halves.ravel(), [computed]]), far)

        return assign

    def told(self, sums: np.ndarray) -> None:
        k = len(self.centres)
        high_low = sums[-1 - 2 * k : -1].reshape(k, 2).tolist()
        self.inertia = [(high << 32) + low for high, low in high_low]
        self.compared.append(int(sums[-1]))

    def moved(self, sums: np.ndarray, far: np.ndarray) -> "Balls":
        """After a round: balls around the members' means, with radii that still hold them."""
        k, n = self.centres.shape
        centres = whole_vectors.means(sums[: k * n].reshape(k, n), sums[k * n : k * n + k], self.centres)
        up = lambda d: math.isqrt(d - 1) + 1 if d else 0
        radii = [up(int(d)) + up(int(m)) for d, m in zip(far, whole_vectors.square(centres, self.centres), strict=True)]
        return Balls(centres, [r * r for r in radii], self.compared)


def cluster(embeddings: DataFrame, clusters: int = 8, rounds: int = 10, scale: int = 1024, length: int = 64, salt: str = "3:") -> tuple[DataFrame, Balls | None]:
    """(vec_id, cluster, distance) of ``embeddings`` (vec_id, embedding) and the final balls with their inertia.

    The first centroids are the ``clusters`` rows with the smallest SHA-256 of ``salt`` and vec_id."""
    if not 1 <= clusters <= 256:
        raise ValueError("1 to 256 clusters")
    spark = embeddings.sparkSession
    rows, _ = whole_vectors.sound(embeddings, scale, length)
    order = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256).asc_nulls_last()
    first = whole_vectors.seeds(rows, [order], clusters, scale)
    if not len(first):
        return rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), None
    balls = Balls(first)
    for number in range(rounds + 1):
        done = whole_vectors.run_pass(rows, balls.assigner(), scale, (), f"clusters-{number}")
        common.discard(spark, rows)
        rows, (sums, far) = done, whole_vectors.totals(done)
        balls.told(sums)
        if number < rounds:
            balls = balls.moved(sums, far)
    number = F.conv(F.hex("code"), 16, 10).cast("int")
    return rows.where("whole is not null").select("vec_id", number.alias("cluster"), F.col("error").alias("distance")), balls


def op12_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all ``embeddings``, 8 of them, 10 rounds; unusable, tied, repeated and missing rows as the module states."""
    found, balls = cluster(common.table(spark, sf_dir, "embeddings"))
    inertia = balls.inertia if balls else []
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in balls.centres.tolist()] if balls else []
    of = lambda values, kind: F.get(F.array(*map(F.lit, values)).cast(f"array<{kind}>"), F.col("cluster"))  # noqa: E731  # a value a cluster
    return found.select("vec_id", "cluster", "distance", of(inertia, "long").alias("cluster_inertia"), F.lit(sum(inertia)).cast("long").alias("inertia"), of(digests, "string").alias("centroid_sha256"))


def _oracle(rounds: int = 10, clusters: int = 8) -> str:
    """The same in SQL, a round after the other, by comparing every vector with every centroid."""
    steps = [f"""kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR)) NULLS LAST) - 1 AS r, vec_id, embedding FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
x AS MATERIALIZED (SELECT r, i AS k, CAST(floor(1024 * CAST(embedding[i + 1] AS DOUBLE)) AS BIGINT) AS v FROM kept, LATERAL (SELECT unnest(range(64)) AS i)),
c0 AS MATERIALIZED (SELECT r AS e, k, v FROM x WHERE r < {clusters})"""]
    for n in range(rounds + 1):
        steps.append(f"""a{n} AS MATERIALIZED (SELECT r, min(d) AS d, arg_min(e, d * 256 + e) AS e FROM
  (SELECT x.r, c.e, sum((x.v - c.v) * (x.v - c.v))::BIGINT AS d FROM x JOIN c{n} c USING (k) GROUP BY ALL) GROUP BY r)""")
        if n < rounds:
            steps.append(f"""c{n + 1} AS MATERIALIZED (SELECT e, k, coalesce(m.v, c.v) AS v FROM c{n} c LEFT JOIN (SELECT a.e AS e, k, ((sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS v
  FROM x JOIN a{n} a USING (r) GROUP BY a.e, k) m USING (e, k))""")
    steps.append(f"digests AS (SELECT e, sha256(string_agg(v::VARCHAR, ',' ORDER BY k)) AS centroid_sha256 FROM c{rounds} GROUP BY e)")
    last = f"SELECT vec_id, e::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY e))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256 FROM a{rounds} JOIN kept USING (r) JOIN digests USING (e)"
    return "WITH " + ",\n".join(steps) + "\n" + last


ORACLE = _oracle()
