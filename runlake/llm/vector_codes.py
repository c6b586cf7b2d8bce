"""Vector compression: a product code whose entries are found by Exponion search in whole numbers.

Vectors become whole numbers, floor(scale * x), and are cut into equal consecutive parts; each part position has a
codebook. Lloyd's rounds assign every part to its nearest entry and replace an entry by the floor of its parts' mean.

Exponion search: a part starts at the entry it had in the round before (in the first round at entry 0). With e the
exact squared distance to it, any entry at least as near lies within twice the distance of the start entry. The start
entry's list of the others, sorted by distance, is scanned as far as that radius and no further. Squared distances are compared
with quarters of squared distances rounded up, in int64, so the radius is provably sufficient and ties go to the smaller index exactly.

Codebooks (parts * entries short vectors) travel with the tasks; vectors stay in their partitions from round to round.

Defined cases: vectors that are null or hold null or non-finite components are dropped; so are those of another length
than the commonest that ``parts`` divides, and those with a component beyond ``most_component`` (1.9e8 for length 64), whose error
would overflow. Rows repeated or tied in vec_id count each for itself, and codebooks take rows tied in vec_id by vector;
null vec_ids come last there. Fewer rows than entries make smaller codebooks. An empty table gives no rows; extra columns
are ignored. A sum of errors beyond a long is null.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlake.llm import common, whole_vectors


@dataclass
class Codebooks:
    """entries[part][entry]: whole-number vectors. ``compared``: distances computed in each round, all parts together."""

    entries: np.ndarray
    scale: int
    compared: list[int] = field(default_factory=list)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def decode(self, code: bytes) -> list[float]:
        """An approximate vector: the middles of the cells of the code's entries."""
        return [(x + 0.5) / self.scale for p, e in enumerate(code) for x in self.entries[p][e].tolist()]

    def assigner(self, sums: bool) -> whole_vectors.Assign:
        """A pass with these codebooks; with ``sums`` it also adds up the parts of each entry."""
        entries = self.entries
        near = [whole_vectors.neighbours(own) for own in entries]
        parts, k, width = entries.shape

        def assign(x: np.ndarray, before: np.ndarray | None) -> whole_vectors.Step:
            codes, errors, added, computed = np.zeros((len(x), parts), np.int64), np.zeros(len(x), np.int64), [], 0
            for p in range(parts):
                part = np.ascontiguousarray(x[:, p * width : (p + 1) * width])
                start = np.zeros(len(x), np.int64) if before is None else before[:, p].astype(np.int64)
                codes[:, p], best, n = whole_vectors.nearest(part, entries[p], start, near[p])
                errors += best
                computed += n
                if sums:
                    added += [a.ravel() for a in whole_vectors.add_by(codes[:, p], part, k)]
            return whole_vectors.Step(codes, errors, np.concatenate([*added, [computed]]).astype(np.int64), np.zeros(0, np.int64))

        return assign

    def moved(self, sums: np.ndarray) -> "Codebooks":
        """After a round: each entry at its parts' mean."""
        parts, k, width = self.entries.shape
        own = sums[:-1].reshape(parts, k * width + k)
        after = [whole_vectors.means(s[: k * width].reshape(k, width), s[k * width :], e) for s, e in zip(own, self.entries, strict=True)]
        return Codebooks(np.stack(after), self.scale, [*self.compared, int(sums[-1])])


def compress(embeddings: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, keep: tuple[str, ...] = ()) -> tuple[DataFrame, Codebooks | None]:
    """(vec_id, keep..., code, error) of ``embeddings`` (vec_id, embedding) and the codebooks; code: a byte a part."""
    if not 1 <= entries <= 256:
        raise ValueError("a code's part is one byte: 1 to 256 entries")
    spark = embeddings.sparkSession
    rows, length = whole_vectors.sound(embeddings, scale, multiple_of=parts, keep=keep)
    first = whole_vectors.seeds(rows, [F.col("vec_id").asc_nulls_last()], entries, scale) if length else np.empty((0, 0))
    if not len(first):
        return rows.select("vec_id", *keep, F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error")).limit(0), None
    books = Codebooks(np.ascontiguousarray(first.reshape(len(first), parts, length // parts).transpose(1, 0, 2)), scale)
    for number in range(rounds + 1):
        done = whole_vectors.run_pass(rows, books.assigner(number < rounds), scale, keep, f"codes-{number}")
        common.discard(spark, rows)  # the table of the round before
        rows, (sums, _) = done, whole_vectors.totals(done)
        if number < rounds:
            books = books.moved(sums)
        else:
            books.compared.append(int(sums[-1]))
    return rows.where("whole is not null").select("vec_id", *keep, "code", "error"), books


def errors_by(coded: DataFrame, label: str, name: str) -> DataFrame:
    """``coded`` with the sum of ``error`` over all rows of equal ``label`` (nulls together) as column ``name``; a label may have most of the rows."""
    key, n = common.spare(coded.columns, "key", "n")
    keyed = coded.withColumn(key, F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit("-")))
    sums = keyed.groupBy(key).agg(F.try_sum("error").alias(name), F.count("*").alias(n))
    return common.join_skewed(keyed, common.materialise(coded.sparkSession, sums, "label-errors"), key, n).drop(key)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all ``embeddings``, 8 parts of 16 entries, 6 rounds; unusable, tied, repeated and missing rows as the module states."""
    coded, books = compress(common.table(spark, sf_dir, "embeddings"), keep=("label",))
    told = errors_by(coded, "label", "label_error")
    return told.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.sha256() if books else None).cast("string").alias("codebooks_sha256"))


def _oracle(rounds: int = 6, parts: int = 8, entries: int = 16) -> str:
    """The same in SQL, a round after the other, by comparing every part with every entry."""
    steps = [f"""kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) - 1 AS r, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
x AS MATERIALIZED (SELECT r, i // (len(embedding) // {parts}) AS p, i % (len(embedding) // {parts}) AS k, CAST(floor(4096 * CAST(embedding[i + 1] AS DOUBLE)) AS BIGINT) AS v
  FROM kept, LATERAL (SELECT unnest(range(len(embedding))) AS i)),
c0 AS MATERIALIZED (SELECT p, r AS e, k, v FROM x WHERE r < {entries})"""]
    for n in range(rounds + 1):
        steps.append(f"""a{n} AS MATERIALIZED (SELECT r, p, min(d) AS d, arg_min(e, d * 256 + e) AS e FROM
  (SELECT x.r, x.p, c.e, sum((x.v - c.v) * (x.v - c.v))::BIGINT AS d FROM x JOIN c{n} c USING (p, k) GROUP BY ALL) GROUP BY r, p)""")
        if n < rounds:
            steps.append(f"""c{n + 1} AS MATERIALIZED (SELECT p, e, k, coalesce(m.v, c.v) AS v FROM c{n} c LEFT JOIN (SELECT p, a.e AS e, k, ((sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS v
  FROM x JOIN a{n} a USING (r, p) GROUP BY p, a.e, k) m USING (p, e, k))""")
    steps.append(f"""coded AS (SELECT r, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY r),
books AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY p, e, k)) AS codebooks_sha256 FROM c{rounds})""")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (r), books"


ORACLE = _oracle()
