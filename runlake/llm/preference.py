"""Preference formatting: a shared prompt, rendered once, and paired masked completions.

A pair is a chosen and a rejected conversation. Their turns are compared place by place; the prompt is
their longest common prefix of turns (same role and text), and what follows is each side's
completion. A row of the result is a pair: prompt, chosen, rejected, and for each completion the
spans of characters that training learns from (an assistant's text and end mark).

The table marks no pairs, so ``pairs`` makes them: conversations that begin with the same turn are
answers to one prompt and are paired in ascending order, the smaller conv_id as chosen; those that are left, one of
a first turn at most, are paired in ascending order too, and ``n_prompt`` is 0 for them. An odd one
out has no rejected side. Numbers within a first turn come from a range partition over (first turn, conv_id)
and the partitions' sizes, so a common first turn isn't gathered in one task.

Turns are compared by digests of role and text, which travel alone; texts are shuffled once, to the
piece that they are rendered in. A piece is ``PIECE`` turn numbers of a pair (and as many rows of one
turn number), so a pair of usual length is one row and a conversation of any length is spread over rows
of bounded size, in the order of (piece, part_of_turn).

Defined cases: rows repeated in full count once; null role is ``unknown``, null text is empty, null turn
comes last; rows that share a turn number stand in the order of their digests; rows with null conv_id
belong to no conversation and aren't rendered; of identical conversations all is prompt; role and end
marks that a text holds are written apart (``<|`` as ``< |``), so that a text can't forge a turn; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runlake.llm import common

LAST_TURN = (1 << 63) - 1
PIECE = 6  #: as a power of two


def clean(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, digest) without nulls."""
    slim = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.coalesce(F.col("turn").cast("long"), F.lit(LAST_TURN)).alias("turn"),
        F.coalesce("role", F.lit("unknown")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    return slim.withColumn("digest", F.md5(F.concat("role", F.lit("\x1f"), "text")))


def places(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, sub, digest): distinct turns with their place; sub numbers what shares a turn."""
    distinct = clean(turns).select("conv_id", "turn", "digest").repartition("conv_id", "turn").distinct()
    return distinct.withColumn("sub", F.row_number().over(W.partitionBy("conv_id", "turn").orderBy("digest")))


def numbered(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` with ``number``: its place from 0 on in ascending order of ``keys``, which tell all rows apart."""
    spark = rows.sparkSession
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    marked = common.materialise(spark, ordered.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    before, offsets = 0, []
    for row in sorted(marked.groupBy(part.alias("part")).count().collect()):  # one row a partition
        offsets.append((row.part, before))
        before += row["count"]
    start = spark.createDataFrame(offsets, "_part long, _start long")
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return marked.join(F.broadcast(start), part == F.col("_part")).withColumn("number", F.col("_start") + within).drop("_at", "_part", "_start")


def pairs(placed: DataFrame) -> DataFrame:
    """(conv_id, pair_id, side) of every conversation; pair_id is the chosen one's conv_id."""
    spark = placed.sparkSession
    first = placed.groupBy("conv_id").agg(F.min(F.struct("turn", "sub", "digest")).alias("first")).select("conv_id", F.col("first.digest").alias("key"))
    every = common.materialise(spark, numbered(first, "key", "conv_id"), "conversations")
    groups = common.materialise(spark, every.groupBy("key").agg(F.min("number").alias("least"), F.count("*").alias("size")), "first-turns")
    ranked = common.join_skewed(every, groups.withColumn("rows", F.col("size")), "key", "rows").withColumn("rank", F.col("number") - F.col("least"))
    ranked = common.materialise(spark, ranked, "ranked")
    left = F.col("rank") >= F.col("size") - F.col("size") % 2
    alone = numbered(ranked.where(left).select("conv_id"), "conv_id").select("conv_id", F.lit("").alias("key"), "number")
    met = ranked.where(~left).select("conv_id", "key", F.col("rank").alias("number")).unionByName(alone)
    both = met.groupBy("key", F.floor(F.col("number") / 2)).agg(F.min("conv_id").alias("pair_id"), F.max("conv_id").alias("other"))
    sides = F.array(F.struct(F.col("pair_id").alias("conv_id"), F.lit("chosen").alias("side")), F.struct(F.col("other").alias("conv_id"), F.lit("rejected").alias("side")))
    return both.select("pair_id", F.explode(sides).alias("s")).select("s.conv_id", "pair_id", "s.side").where("side = 'chosen' or conv_id <> pair_id")


def splits(placed: DataFrame, sided: DataFrame) -> DataFrame:
    """``sided`` (conv_id, pair_id, side) with ``split``: the first place (turn, sub) at which the sides differ, null if none does."""
    at = placed.join(sided, "conv_id").groupBy("pair_id", "turn", "sub").agg(F.count("*").alias("n"), F.min("digest").alias("low"), F.max("digest").alias("high"))
    split = at.where((F.col("n") < 2) | (F.col("low") != F.col("high"))).groupBy("pair_id").agg(F.min(F.struct("turn", "sub")).alias("split"))
    return sided.join(split, "pair_id", "left")


def _mask(rows: Column) -> Column:
    """The spans that ``rows`` (rendered, mask_start, mask_end) are learned from, in the joined text."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<a:bigint,b:bigint>>").alias("spans"))
    span = lambda acc, r: F.array(F.struct((acc["at"] + r["mask_start"]).alias("a"), (acc["at"] + r["mask_end"]).alias("b")))
    step = lambda acc, r: F.struct((acc["at"] + F.length(r["rendered"])).alias("at"), F.when(r["mask_end"] > 0, F.concat(acc["spans"], span(acc, r))).otherwise(acc["spans"]).alias("spans"))
    return F.aggregate(rows, start, step, lambda acc: acc["spans"])


def format_pairs(turns: DataFrame, split: DataFrame, most_broadcast: int = 1_000_000) -> DataFrame:
    """From turns and ``splits``: pair_id, piece, part_of_turn, n_prompt, prompt, chosen, rejected, chosen_mask, rejected_mask.

    ``split`` (a short row a conversation) is broadcast up to ``most_broadcast`` rows, beyond that joined by a shuffle."""
    own = F.broadcast(split) if split.count() <= most_broadcast else split
    rows = clean(turns).join(own, "conv_id").withColumn("piece", F.shiftright("turn", PIECE)).repartition("pair_id", "piece")
    rows = rows.dropDuplicates(["pair_id", "piece", "side", "turn", "digest"])
    rows = rows.withColumn("sub", F.row_number().over(W.partitionBy("pair_id", "piece", "side", "turn").orderBy("digest")))
    shared = F.col("split").isNull() | (F.struct("turn", "sub") < F.col("split"))
    part = F.when(shared, "prompt").otherwise(F.col("side"))
    header = F.concat(F.lit("<|"), F.replace("role", F.lit("|"), F.lit("")), F.lit("|>\n"))
    rendered = F.concat(header, F.replace("text", F.lit("<|"), F.lit("< |")), F.lit("<|end|>\n"))
    learn = ~shared & (F.col("role") == "assistant")
    once = rows.where(~shared | (F.col("side") == "chosen")).select(
        "pair_id", "piece", F.shiftright(F.col("sub") - 1, PIECE).alias("part_of_turn"), "turn", "sub", part.alias("part"), rendered.alias("rendered"),
        F.when(learn, F.length(header)).otherwise(0).cast("long").alias("mask_start"),
        F.when(learn, F.length(rendered) - 1).otherwise(0).cast("long").alias("mask_end"),
    )
    row = F.struct("turn", "sub", "rendered", "mask_start", "mask_end")
    held = once.groupBy("pair_id", "piece", "part_of_turn").agg(*[F.array_sort(F.collect_list(F.when(F.col("part") == p, row))).alias(p) for p in ("prompt", "chosen", "rejected")])
    text = lambda p: F.array_join(F.transform(p, lambda r: r["rendered"]), "").alias(p)
    return held.select("pair_id", "piece", "part_of_turn", F.size("prompt").alias("n_prompt"), *map(text, ("prompt", "chosen", "rejected")), _mask(F.col("chosen")).alias("chosen_mask"), _mask(F.col("rejected")).alias("rejected_mask"))


def preferences(turns: DataFrame) -> DataFrame:
    """All conversations, paired and formatted; ``rejected_id`` is null for the odd one out."""
    spark = turns.sparkSession
    placed = common.materialise(spark, places(turns), "places")
    sided = common.materialise(spark, pairs(placed), "pairs")
    other = sided.where("side = 'rejected'").select("pair_id", F.col("conv_id").alias("rejected_id"))
    return format_pairs(turns, common.materialise(spark, splits(placed, sided), "splits")).join(other, "pair_id", "left")


def op10_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``conversations`` as pairs, one row a pair (of a pair over 64 turns: a row for each 64), masks as a-b,a-b; odd cases as the module states."""
    told = preferences(common.table(spark, sf_dir, "conversations"))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["a"], s["b"])), ",").alias(c)
    return told.select("pair_id", "rejected_id", "piece", "part_of_turn", "n_prompt", "prompt", "chosen", "rejected", spans("chosen_mask"), spans("rejected_mask"))


ORACLE = r"""
WITH t AS (SELECT DISTINCT conv_id, coalesce(turn, 9223372036854775807) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT *, md5(role || chr(31) || text) AS digest, row_number() OVER (PARTITION BY conv_id, turn ORDER BY md5(role || chr(31) || text)) AS sub FROM t),
f AS (SELECT conv_id, arg_min(digest, (turn, sub)) AS k FROM p GROUP BY conv_id),
n AS (SELECT conv_id, k, row_number() OVER (PARTITION BY k ORDER BY conv_id) - 1 AS place, count(*) OVER (PARTITION BY k) AS size FROM f),
a AS (SELECT conv_id, k, place // 2 AS num FROM n WHERE place < size - size % 2
  UNION ALL SELECT conv_id, '' AS k, (row_number() OVER (ORDER BY conv_id) - 1) // 2 AS num FROM n WHERE place >= size - size % 2),
b AS (SELECT min(conv_id) AS pair_id, CASE WHEN count(*) > 1 THEN max(conv_id) END AS rejected_id FROM a GROUP BY k, num),
s AS (SELECT p.*, pair_id, rejected_id, CASE WHEN p.conv_id = pair_id THEN 'chosen' ELSE 'rejected' END AS side FROM b JOIN p ON p.conv_id = pair_id OR p.conv_id = rejected_id),
m AS (SELECT pair_id, turn, sub FROM s GROUP BY pair_id, turn, sub HAVING count(*) < 2 OR count(DISTINCT digest) > 1),
c AS (SELECT pair_id, min((turn, sub)) AS split FROM m GROUP BY pair_id),
j AS (SELECT s.*, coalesce((turn, sub) < split, TRUE) AS shared FROM s LEFT JOIN c USING (pair_id)),
r AS (SELECT pair_id, rejected_id, turn >> 6 AS piece, CAST((sub - 1) >> 6 AS INTEGER) AS part_of_turn, turn, sub, CASE WHEN shared THEN 'prompt' ELSE side END AS part, role = 'assistant' AND NOT shared AS learn,
  length('<|' || replace(role, '|', '') || '|>' || chr(10)) AS head, '<|' || replace(role, '|', '') || '|>' || chr(10) || replace(text, '<|', '< |') || '<|end|>' || chr(10) AS rendered FROM j WHERE NOT shared OR side = 'chosen'),
o AS (SELECT *, coalesce(sum(length(rendered)) OVER (PARTITION BY pair_id, piece, part_of_turn, part ORDER BY turn, sub ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM r)
SELECT pair_id, rejected_id, piece, part_of_turn, CAST(count(*) FILTER (WHERE part = 'prompt') AS INTEGER) AS n_prompt,
  coalesce(string_agg(rendered, '' ORDER BY turn, sub) FILTER (WHERE part = 'prompt'), '') AS prompt,
  coalesce(string_agg(rendered, '' ORDER BY turn, sub) FILTER (WHERE part = 'chosen'), '') AS chosen,
  coalesce(string_agg(rendered, '' ORDER BY turn, sub) FILTER (WHERE part = 'rejected'), '') AS rejected,
  coalesce(string_agg(CAST(start + head AS BIGINT) || '-' || CAST(start + length(rendered) - 1 AS BIGINT), ',' ORDER BY turn, sub) FILTER (WHERE part = 'chosen' AND learn), '') AS chosen_mask,
  coalesce(string_agg(CAST(start + head AS BIGINT) || '-' || CAST(start + length(rendered) - 1 AS BIGINT), ',' ORDER BY turn, sub) FILTER (WHERE part = 'rejected' AND learn), '') AS rejected_mask
FROM o GROUP BY pair_id, rejected_id, piece, part_of_turn
"""
