"""SimHash near-duplicates by anchor-point covering.

Fingerprints link at ``THRESHOLD`` = 3 or fewer differing bits. Two that link differ in at most one
bit in one of their two 32-bit halves, so each half is covered on its own, with threshold 1. The
anchors of a half are the words of the [32, 27] code made of the [31, 26] Hamming code and one free
bit: covering radius 1, so every half value has an anchor (its home) within one bit. A fingerprint
goes to every anchor within radius plus threshold = 2 bits of its half (17 of them, or 2 if the half
is itself an anchor). If the halves of x and y differ in at most one bit, y is within two bits of
x's home, so the pair meets there: no link is lost.

Fingerprints are compared per anchor with a popcount of the XOR of all 64 bits. Only distinct
fingerprints take part, so exact copies cost nothing. A group of an anchor emits a spanning forest
of its links, not all pairs. An anchor with more than ``most`` fingerprints isn't held: its members
pass on to a second round, split by the four bytes of the other half (at most 3 differing bits leave
one byte equal), which is exact too.

Defined cases: null text and text without words have fingerprint zero and link like any other;
rows with null doc_id get a fingerprint, and their group's smallest non-null id (or null); rows that
repeat a doc_id are treated each by its own text; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from runlake.llm import common
from runlake.llm.components import Forest, components, thin

THRESHOLD = 3


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Bit i is 1 if it is set in over half of the hashes of the word shingles, repeats included."""
    words = common.lower_ascii(text).split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    h, join = xxhash.xxh64_intdigest, b" ".join
    counts, n = np.zeros(64, np.int64), len(words) - shingle + 1
    for at in range(0, n, 1 << 16):
        part = words[at : at + (1 << 16) + shingle - 1]
        hashes = np.array([h(join(s), seed) for s in zip(*(part[k:] for k in range(shingle)), strict=False)], "<u8")
        counts += np.unpackbits(hashes.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of ``docs`` and fp, the unsigned fingerprint's bits as a signed long."""
    slim = docs.select("text", *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            fps = np.array([fingerprint(t) for t in batch.column(0).to_pylist()], "u8")
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(fps.view("i8"))], [*keep, "fp"])

    return common.map_arrow(slim, run, StructType([*slim.schema.fields[1:], StructField("fp", LongType())]))


def _syndromes() -> np.ndarray:
    """For each byte of a half and its value: the XOR of the positions (1 to 31) of its set bits; the top bit is free."""
    out = np.zeros((4, 256), np.uint32)
    for byte in range(4):
        for value in range(256):
            for bit in range(8):
                at = 8 * byte + bit
                if value >> bit & 1 and at < 31:
                    out[byte, value] ^= at + 1
    return out


def _steps() -> list[np.ndarray]:
    """For each syndrome: the masks that lead from a half value to its anchors within 2 bits, the home first."""
    free, out = 1 << 31, [np.array([0, 1 << 31], np.uint32)]
    for s in range(1, 32):
        home = 1 << (s - 1)
        pairs = [1 << (a - 1) | 1 << ((a ^ s) - 1) for a in range(1, 32) if 0 < a ^ s and a < a ^ s]
        out.append(np.array([home, home | free, *pairs], np.uint32))
    return out


_SYNDROMES, _STEPS = _syndromes(), _steps()


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For unsigned fingerprints: (row, key, home) of all their anchors; key is the half's number and the anchor."""
    rows, keys, homes = [], [], []
    for side in range(2):
        half = (fps >> np.uint64(32 * side)).astype(np.uint32)
        parts = half[:, None].view("u1").reshape(-1, 4)
        s = _SYNDROMES[0][parts[:, 0]] ^ _SYNDROMES[1][parts[:, 1]] ^ _SYNDROMES[2][parts[:, 2]] ^ _SYNDROMES[3][parts[:, 3]]
        for value in np.unique(s):
            at, steps = np.flatnonzero(s == value), _STEPS[value]
            rows.append(np.repeat(at, len(steps)))
            keys.append((half[at, None] ^ steps).ravel().astype(np.int64) | side << 32)
            homes.append(np.tile(np.arange(len(steps)) == 0, len(at)))
    return tuple(np.concatenate(x) for x in (rows, keys, homes)) if rows else (np.empty(0, int),) * 3


def close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= THRESHOLD


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what is linked in a group, at most one per member: breadth-first over those not yet reached."""
    out: list[tuple[int, int]] = []
    left = np.unique(fps)
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = close(left, x)
            if near.any():
                out += [(int(x), int(y)) for y in left[near]]
                queue += list(left[near])
                left = left[~near]
    return out


def compare(batches: Iterator[pa.RecordBatch], most: int | None) -> Iterator[pa.RecordBatch]:
    """From (key, fp, home) sorted by key to links (key null) and, past ``most`` members, the members themselves (b null)."""
    schema = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
    linked = Forest()
    tail: list[np.ndarray] | None = None
    passing: int | None = None  # the key of a group that was too large

    def links(a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.view("i8").tolist(), b.view("i8").tolist(), strict=True):
            linked.join(x, y)

    def drain() -> pa.RecordBatch:
        nonlocal linked
        a, b = linked.stars()
        linked = Forest()
        return pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    def work(keys: np.ndarray, fps: np.ndarray, homes: np.ndarray) -> None:
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[first, len(keys)])
        for f, n in zip(first[sizes > 48].tolist(), sizes[sizes > 48].tolist(), strict=True):
            pairs = forest(fps[f : f + n])
            if pairs:
                links(*np.array(pairs, "u8").T.copy())
        few = np.repeat((sizes > 1) & (sizes <= 48), sizes)
        keys, fps, homes = keys[few], fps[few], homes[few]
        here, step = np.arange(len(keys)), 1
        while len(here := here[here + step < len(keys)]) and len(here := here[keys[here] == keys[here + step]]):
            hit = here[(homes[here] | homes[here + step]) & close(fps[here], fps[here + step])]
            links(fps[hit], fps[hit + step])
            step += 1

    for batch in batches:
        if not batch.num_rows:
            continue
        now = [np.asarray(batch.column(0)), np.asarray(batch.column(1)).view("u8"), np.asarray(batch.column(2).to_numpy(zero_copy_only=False), bool)]
        if tail is not None:
            now = [np.concatenate(x) for x in zip(tail, now, strict=True)]
        cut = int(np.searchsorted(now[0], now[0][-1]))  # the last group may go on in the next batch
        if passing is not None:
            end = int(np.searchsorted(now[0], passing, "right"))
            if end:
                yield pa.RecordBatch.from_arrays([pa.array(now[0][:end]), pa.array(now[1][:end].view("i8")), pa.nulls(end, pa.int64())], schema=schema)
            now, cut = [x[end:] for x in now], max(0, cut - end)
            if len(now[0]):
                passing = None
        if len(now[0]):
            if cut:
                work(*(x[:cut] for x in now))
            tail = [x[cut:] for x in now]
            if most is not None and len(tail[0]) > most:
                passing = int(tail[0][0])
                yield pa.RecordBatch.from_arrays([pa.array(tail[0]), pa.array(tail[1].view("i8")), pa.nulls(len(tail[0]), pa.int64())], schema=schema)
                tail = None
        else:
            tail = None
        if len(linked.up) > 100_000:
            yield drain()
    if tail is not None and len(tail[0]):
        work(*tail)
    yield drain()


def links(fps: DataFrame, most: int = 20_000) -> DataFrame:
    """``fps`` (fp, distinct) to edges (a, b) that connect all fingerprints that link."""
    spark = fps.sparkSession
    placed, found = "key long, fp long, home boolean", "key long, a long, b long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.asarray(batch.column(0))
            for at in range(0, len(own), 4096):
                part = own[at : at + 4096]
                row, key, home = anchors(part.view("u8"))
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(part[row], pa.int64()), pa.array(home, pa.bool_())], ["key", "fp", "home"])

    at_anchors = common.map_arrow(fps.select("fp"), place, placed).repartition("key").sortWithinPartitions("key")
    first = common.materialise(spark, common.map_arrow(at_anchors, lambda b: compare(b, most), found), "links")
    edges = first.where("key is null").select("a", "b")
    if first.where("key is not null").limit(1).count():
        #: key's bit 32 tells the half; the second round splits by the bytes of the other one.
        other = F.when(F.col("key") >= F.lit(1 << 32), F.col("a")).otherwise(F.shiftright("a", 32)).bitwiseAND(F.lit(0xFFFFFFFF))
        parts = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.shiftrightunsigned(other, 8 * k).bitwiseAND(F.lit(255)).alias("v")) for k in range(4)]))
        again = first.where("key is not null").select("key", F.col("a").alias("fp"), parts.alias("p")).select(F.xxhash64("key", "p.k", "p.v").alias("key"), "fp", F.lit(True).alias("home"))
        second = common.map_arrow(again.repartition("key").sortWithinPartitions("key"), lambda b: compare(b, None), found)
        edges = edges.union(second.where("key is null").select("a", "b"))
    return edges


def component_ids(marked: DataFrame) -> DataFrame:
    """From rows (doc_id, fp) to (fp, group_fp, component_id, n), one row per fingerprint; n: its rows."""
    spark = marked.sparkSession
    classes = common.materialise(spark, marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "classes")
    roots = components(thin(links(classes)))
    grouped = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("group_fp"))
    grouped = common.materialise(spark, grouped, "groups")
    smallest = grouped.groupBy("group_fp").agg(F.min("least").alias("component_id"), F.count("*").alias("fps"))  # pre-aggregated before the shuffle
    out = common.join_skewed(grouped, smallest, "group_fp", "fps").select("fp", "group_fp", "component_id", "n")
    return common.materialise(spark, out, "components")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) per row of ``docs`` (doc_id, text)."""
    marked = common.materialise(docs.sparkSession, fingerprints(docs), "fingerprints")
    return common.join_skewed(marked, component_ids(marked).drop("group_fp"), "fp", "n").select("doc_id", "fp", "component_id")


def row_digest(docs: DataFrame) -> F.Column:
    """Tells rows apart by doc_id, text (null isn't empty) and all other columns but maps."""
    others = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and f.name != "text"]
    parts = [F.col("doc_id").cast("string"), F.hex(F.xxhash64(*others)), F.col("text")]
    return F.unhex(F.md5(F.concat(*[F.coalesce(F.concat(F.lit("="), x), F.lit("-")) for x in parts])))


def one_of_each(docs: DataFrame, most_broadcast: int = 500_000) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that of the smallest doc_id (null ids last; of equal ids the first by digest).

    Rows are told apart by a digest of all columns; rows that agree in all are one document, and one
    of them stays. Texts aren't shuffled: the digests of the rows that go are broadcast, up to
    ``most_broadcast`` of them (16 bytes each); beyond that texts meet them by a shuffled join. Only rows that
    are repeated in full meet each other, and only if they stay.
    """
    spark, names = docs.sparkSession, docs.columns
    id_, row = common.spare(names, "id", "row")
    rows = docs.withColumn(row, row_digest(docs))
    slim = rows.select(F.col("doc_id").cast("long").alias(id_), "text", row)
    marked = common.materialise(spark, fingerprints(slim, keep=(id_, row)), "fingerprints")
    order = F.struct(F.col(id_).isNull().alias("none"), F.col(id_).alias("id"), F.col(row).alias("row"))
    first = marked.groupBy("fp").agg(F.min(order).alias("first"))  # pre-aggregated, so copies meet no join
    grouped = first.join(component_ids(marked.withColumnRenamed(id_, "doc_id")).select("fp", "group_fp"), "fp")
    chosen = common.materialise(spark, grouped.groupBy("group_fp").agg(F.min("first").alias("first")).select(F.col("first.row").alias(row)), "chosen")
    counted = common.materialise(spark, marked.groupBy(row).agg(F.count("*").alias("n")), "rows")
    gone = common.materialise(spark, counted.join(chosen, row, "left_anti").select(row), "gone")
    again = common.materialise(spark, counted.where("n > 1").join(chosen, row, "left_semi").select(row), "repeated")
    n_gone, n_again = gone.count(), again.count()
    if n_gone + n_again <= most_broadcast:
        gone, again = F.broadcast(gone), F.broadcast(again)
    left = rows.join(gone, row, "left_anti")
    if n_again:
        left = left.join(again, row, "left_anti").unionByName(left.join(again, row, "left_semi").dropDuplicates([row]))
    return left.select(*[F.col(f"`{c}`") for c in names])


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash groups over all ``documents``: doc_id, fingerprint, component_id; null, empty, tied, repeated and missing rows as the module states."""
    found = near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
