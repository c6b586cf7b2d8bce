"""Token-ID store: independent zstandard frames with a trailing seek table and per-frame checksums.

File layout (the public zstandard seekable format, so any zstd tool still reads the ids):

* data frames of ids as little-endian unsigned 16-bit integers where the vocabulary fits, else 32-bit.
  A frame holds whole documents, ``frame_tokens`` ids of them at most; a longer document has frames of
  its own. So a document of up to that length costs one frame, and nobody reads more than that in vain;
* one skippable frame with the document index: zstd-compressed ``int64`` doc_ids, a byte each for
  null ids, and ``int64`` token counts;
* one skippable frame with the seek table: per frame its compressed size, decompressed size and
  the low 32 bits of the XXH64 of its content; then the number of frames, a descriptor, a magic.

``write_store`` encodes the texts where they lie and shuffles the ids (two bytes a token, less than
the text) to ranges of doc_id, so files and documents in them are in ascending order, and a task that is
run again has nothing to encode. The manifest has each file's first and last doc_id. A task writes a file under a name of its own and reports it in a manifest row; only files of
successful attempts are in the manifest, so lost executors and retried tasks leave no wrong file.

Defined cases: null text is empty (one end id); rows of equal doc_id stay separate documents, in
order of their text's hash; null doc_ids come first; an empty table gives no files and no rows;
extra columns are ignored. A checksum that doesn't fit raises ``ValueError``.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runlake.llm import common
from runlake.llm.tokens import encoder, ids_of

# Fixed values of the zstandard seekable format.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_SEEK_TABLE = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

MANIFEST = "part int, uri string, n_docs long, n_tokens long, first_id long, last_id long, null_ids long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


class StoreWriter:
    """Writes one file, frame by frame; holds one frame and the document index."""

    def __init__(self, sink, width: int, frame_tokens: int, level: int = 3) -> None:
        self.sink, self.kind, self.frame_tokens = sink, f"<u{width}", frame_tokens
        self.zstd = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_tokens = 0
        self.table: list[tuple[int, int, int]] = []
        self.doc_ids: list[int | None] = []
        self.counts: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.counts.append(len(ids))
        self.n_tokens += len(ids)
        if self.n_waiting + len(ids) > self.frame_tokens:
            self._flush()
        self.waiting.append(ids.astype(self.kind, copy=False))
        self.n_waiting += len(ids)
        if self.n_waiting > self.frame_tokens:  # one long document
            self._flush()

    def _flush(self) -> None:
        joined = np.concatenate(self.waiting) if self.waiting else np.empty(0, self.kind)
        for at in range(0, len(joined), self.frame_tokens):
            body = joined[at : at + self.frame_tokens].tobytes()
            packed = self.zstd.compress(body)
            self.sink.write(packed)
            self.table.append((len(packed), len(body), xxhash.xxh64_intdigest(body) & 0xFFFFFFFF))
        self.waiting, self.n_waiting = [], 0

    def close(self) -> None:
        self._flush()
        nulls = np.array([x is None for x in self.doc_ids], "u1")
        ids = np.array([x or 0 for x in self.doc_ids], "<i8")
        width, frame = int(self.kind[2:]), self.frame_tokens
        index = struct.pack("<QBQ", len(ids), width, frame) + self.zstd.compress(ids.tobytes() + nulls.tobytes() + np.array(self.counts, "<i8").tobytes())
        self.sink.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        self.table.append((len(index) + 8, 0, 0))
        table = b"".join(struct.pack("<III", *row) for row in self.table) + struct.pack("<IBI", len(self.table), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_SEEK_TABLE, len(table)) + table)


class StoreReader:
    """Reads one file by its seek table; ``ids(n)`` decompresses only the frames that document n lies in."""

    def __init__(self, source) -> None:
        self.source = source
        size = source.size()
        source.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE_MAGIC or flags != CHECKSUM_FLAG:
            raise ValueError("no seek table at the end of the file")
        source.seek(size - 9 - 12 * n)
        table = np.frombuffer(source.read(12 * n), "<u4").reshape(n, 3)
        starts = np.concatenate([[0], np.cumsum(table[:, 0], dtype=np.int64)])
        source.seek(int(starts[n - 1]) + 8)
        index = source.read(int(table[n - 1, 0]) - 8)
        docs, self.width, self.frame_tokens = struct.unpack_from("<QBQ", index)
        body = zstandard.ZstdDecompressor().decompress(index[17:], max_output_size=17 * docs + 1) if docs else b""
        self.doc_ids = np.frombuffer(body, "<i8", docs)
        self.nulls = np.frombuffer(body, "u1", docs, 8 * docs).astype(bool)
        self.counts = np.frombuffer(body, "<i8", docs, 9 * docs)
        self.firsts = np.concatenate([[0], np.cumsum(self.counts)])
        self.frames, self.starts = table[: n - 1], starts
        self.edges = np.concatenate([[0], np.cumsum(self.frames[:, 1], dtype=np.int64)]) // self.width
        self.zstd = zstandard.ZstdDecompressor()
        self.held: tuple[int, np.ndarray] = (-1, np.empty(0))

    def frame(self, k: int) -> np.ndarray:
        if self.held[0] != k:
            packed, size, check = map(int, self.frames[k])
            self.source.seek(int(self.starts[k]))
            body = self.zstd.decompress(self.source.read(packed), max_output_size=size)
            if xxhash.xxh64_intdigest(body) & 0xFFFFFFFF != check:
                raise ValueError(f"frame {k}: checksum doesn't fit")
            self.held = (k, np.frombuffer(body, f"<u{self.width}"))
        return self.held[1]

    def ids(self, n: int) -> np.ndarray:
        at, end, out = int(self.firsts[n]), int(self.firsts[n + 1]), []
        while at < end:
            k = int(np.searchsorted(self.edges, at, "right")) - 1
            out.append(self.frame(k)[at - int(self.edges[k]) : end - int(self.edges[k])])
            at += len(out[-1])
        return np.concatenate(out) if out else np.empty(0, f"<u{self.width}")


def opened(uri: str, write: bool = False):
    """A file in any store that pyarrow knows (local, HDFS, object stores)."""
    fs, path = pafs.FileSystem.from_uri(uri)
    if not write:
        return fs.open_input_file(path)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    return fs.open_output_stream(path, compression=None)


def ranges(keys: DataFrame, part_bytes: int, sample: int = 20_000, per_range: int = 20, most: int = 2_000_000) -> list[tuple[bool, int, int]]:
    """Ascending (doc_id isn't null, doc_id, tie) at which ranges of about ``part_bytes`` of text begin, but for the first.

    Taken from a random sample of ``sample`` rows, or, where that isn't ``per_range`` for each range that the text needs, of so many
    (``most`` in all: beyond 3 TB at 32 MB a range, ranges grow). Ranges are even in the sample's bytes, not its rows; a range has a row of the sample at least."""
    n = keys.count()

    def drawn(rows: int) -> list[tuple[bool, int, int, int]]:
        share = rows / max(1, n)
        seen = (keys if share >= 1 else keys.sample(share, 7)).select("doc_id", "tie", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).toArrow().to_pydict()
        return sorted((x is not None, x or 0, tie, size) for x, tie, size in zip(seen["doc_id"], seen["tie"], seen["size"], strict=True))

    def needed(found: list[tuple[bool, int, int, int]]) -> int:
        return -(-int(sum(x[3] for x in found) / max(1, len(found)) * n) // part_bytes)

    found = drawn(sample)
    if needed(found) * per_range > len(found) < n:
        found = drawn(min(most, needed(found) * per_range))
    parts = min(needed(found), max(1, len(found) // per_range)) if len(found) < n else needed(found)
    ends = np.cumsum([x[3] for x in found])
    at = np.searchsorted(ends, [ends[-1] * k // parts for k in range(1, parts)], "right") if parts > 1 else []
    return sorted({found[k][:3] for k in at if 0 < k < len(found)})


def encoded(docs: DataFrame, tokenizer: str, end_id: int, part_bytes: int = 32 << 20) -> DataFrame:
    """(doc_id, ids) of ``docs`` (doc_id, text), ``end_id`` appended, in ranges of ascending doc_id, equal ids by their text's hash.

    ``ids`` are bytes, ``id_bytes`` wide each. Ranges hold about ``part_bytes`` of text; rows alike in id and text stay in one."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
    begins = ranges(rows, part_bytes)
    shared = docs.sparkSession.sparkContext.broadcast(begins)  # a twentieth of the sample at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, begins = encoder(tokenizer), shared.value
        kind = f"<u{id_bytes(tokenizer, end_id)}"
        end = np.array([end_id], kind).tobytes()
        for batch in common.slices(batches):
            keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            part = [bisect_right(begins, (x is not None, x or 0, tie)) for x, tie in keys]
            ids = [ids_of(enc.encode(t)).astype(kind).tobytes() + end for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_pydict({"part": pa.array(part, pa.int32()), "doc_id": batch.column(0), "tie": batch.column(1), "ids": pa.array(ids, pa.binary())})

    apart = common.map_arrow(rows, run, "part int, doc_id long, tie long, ids binary").repartitionById(len(begins) + 1, "part")
    return apart.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie").select("doc_id", "ids")


def id_bytes(tokenizer: str, end_id: int) -> int:
    """The bytes of an id in the store and in ``encoded``: two if all ids fit."""
    return 2 if max(encoder(tokenizer).tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4


def write_store(docs: DataFrame, tokenizer: str, end_id: int, frame_tokens: int = 1 << 14) -> DataFrame:
    """Encode and write ``docs`` (doc_id, text); return the manifest: a row a file with ``MANIFEST``'s columns and start (ids in earlier files)."""
    spark = docs.sparkSession
    folder = common.fresh_uri(spark, "tokens")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = id_bytes(tokenizer, end_id)
        part = TaskContext.get().partitionId()
        uri, writer, sink = f"{folder}/{part:06d}-{uuid.uuid4().hex}.tok.zst", None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                sink = opened(uri, write=True)
                writer = StoreWriter(sink, width, frame_tokens)
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                writer.add(doc_id, np.frombuffer(ids.as_buffer(), writer.kind))
        if writer is not None:
            writer.close()
            sink.close()
            named = [x for x in writer.doc_ids if x is not None]
            first, last = (named[0], named[-1]) if named else (None, None)
            row = {"part": part, "uri": uri, "n_docs": len(writer.counts), "n_tokens": writer.n_tokens, "first_id": first, "last_id": last, "null_ids": len(writer.counts) - len(named)}
            yield pa.RecordBatch.from_pylist([row], pa.schema([(c, {"int": pa.int32(), "string": pa.string(), "long": pa.int64()}[t]) for c, t in map(str.split, MANIFEST.split(", "))]))

    files = common.materialise(spark, common.map_arrow(encoded(docs, tokenizer, end_id), write, MANIFEST), "token-manifest")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one short row a file
    return files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_store(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32 (of its ids as little-endian unsigned 32-bit integers)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with opened(row["uri"]) as source:
                    store = StoreReader(source)
                    for at in range(0, len(store.counts), 4096):
                        n = range(at, min(at + 4096, len(store.counts)))
                        crc = [zlib.crc32(store.ids(k).astype("<u4").tobytes()) for k in n]
                        here = slice(n.start, n.stop)
                        yield pa.RecordBatch.from_pydict({"doc_id": pa.array(store.doc_ids[here], pa.int64(), mask=store.nulls[here]), "start": pa.array(row["start"] + store.firsts[here], pa.int64()), "n_tokens": pa.array(store.counts[here], pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    files = max(1, manifest.count())
    return common.map_arrow(manifest.select("uri", "start").repartition(min(files, 10_000)), read, READ)


def read_documents(manifest: DataFrame, doc_ids: list[int]) -> dict[int, list[np.ndarray]]:
    """The ids of a few documents (on the caller's machine): only files whose ids span one of them are opened, only their frames decompressed."""
    out: dict[int, list[np.ndarray]] = {}
    asked = F.array(*[F.lit(int(x)).cast("long") for x in doc_ids])
    for row in manifest.where(F.exists(asked, lambda x: x.between(F.col("first_id"), F.col("last_id")))).select("uri").collect():
        with opened(row.uri) as source:
            store = StoreReader(source)
            for n in np.flatnonzero(np.isin(store.doc_ids, doc_ids) & ~store.nulls):
                out.setdefault(int(store.doc_ids[n]), []).append(store.ids(int(n)))
    return out


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` encoded, written as seekable files and read back: doc_id, start, n_tokens, ids_crc32; null, empty, repeated and missing rows as the module states."""
    return read_store(write_store(common.table(spark, sf_dir, "documents"), "byte_bpe_50k.json", end_id=2))
