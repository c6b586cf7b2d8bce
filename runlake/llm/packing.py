"""Order-preserving packing by dynamic programming.

Documents keep their order (ascending doc_id). In a block of consecutive documents every document
end, every sentence end and, where those are too far apart, a hard cut is a possible cut. A
sequence is the window between two chosen cuts; its cost is the padding it needs plus the penalty
of its end (none at a document's end, ``sentence_cut`` inside a document, ``hard_cut`` inside a
sentence). With f the least cost up to a cut and W the window:

    f(j) = penalty(j) + min over i with pos(j) - pos(i) <= W of f(i) + padding(pos(j) - pos(i))

Padding is W - length, so its minimum is that of f(i) + pos(i) over a sliding window: a monotone
queue gives it in constant time. Lengths that are powers of two need no padding; the few such
transitions are found by binary search beforehand.

Defined cases: null text is empty (the end id alone); rows of equal doc_id are separate documents in
order of their text's hash; null doc_ids come first; an empty table gives no rows; extra columns are
ignored; a document longer than the window is cut into several pieces, and nothing is dropped.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from runlake.llm import common
from runlake.llm.token_store import encoded, id_bytes
from runlake.llm.tokens import encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cuts(doc_ends: np.ndarray, sentence_ends: np.ndarray, window: int, sentence_cut: float, hard_cut: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a sequence may end, from 0 on, and their penalties."""
    total = int(doc_ends[-1])
    pos = np.unique(np.concatenate([[0], doc_ends, sentence_ends]))
    gaps = np.flatnonzero(np.diff(pos) > window)
    hard = [np.arange(pos[k] + window, pos[k + 1], window) for k in gaps]
    if hard:
        pos = np.unique(np.concatenate([pos, *hard]))
    penalty = np.full(len(pos), float(sentence_cut))
    if hard:
        penalty[np.isin(pos, np.concatenate(hard))] = hard_cut
    penalty[np.isin(pos, doc_ends)] = 0.0
    penalty[0] = 0.0
    assert pos[-1] == total
    return pos, penalty


def plan(pos: np.ndarray, penalty: np.ndarray, window: int, exact_from: int, each: float = 1.0) -> np.ndarray:
    """The chosen ends of sequences, ascending. ``each``: what one sequence more costs."""
    exact: dict[int, list[int]] = {}
    length = exact_from
    while length <= window:
        at = np.searchsorted(pos, pos - length)
        for j in np.flatnonzero((pos >= length) & (pos[at] == pos - length)).tolist():
            exact.setdefault(j, []).append(int(at[j]))
        length *= 2
    where, cost = pos.tolist(), penalty.tolist()
    least, back = [0.0] * len(where), [0] * len(where)
    queue: deque[tuple[float, int, int]] = deque([(0.0, 0, 0)])  # (f + pos, pos, index), both ascending
    for j in range(1, len(where)):
        here = where[j]
        while queue[0][1] < here - window:
            queue.popleft()
        best, i = queue[0][0] + window - here, queue[0][2]
        for k in exact.get(j, ()):
            if least[k] < best:
                best, i = least[k], k
        best += cost[j] + each
        least[j], back[j] = best, i
        key = best + here
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, here, j))
    ends, j = [], len(where) - 1
    while j:
        ends.append(where[j])
        j = back[j]
    return np.array(ends[::-1], np.int64)


def sentence_enders(tokenizer) -> np.ndarray:
    """Whether an id ends a sentence: marks only, one of them a full stop, question or exclamation mark."""
    fits = re.compile(r"[\"')\]*]*[.!?][.!?\"')\]*]*(</w>)?").fullmatch
    flags = np.zeros(max(tokenizer.get_vocab().values()) + 1, bool)
    for piece, n in tokenizer.get_vocab().items():
        flags[n] = bool(fits(piece))
    return flags


def pack(docs: DataFrame, tokenizer: str, end_id: int, window: int = 4096, sentence_cut: float = 4.0, hard_cut: float = 64.0, exact_from: int = 256, block_tokens: int = 1 << 19, with_ids: bool = False) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if asked for).

    Texts are encoded where they lie and shuffled as ids. A task packs its range of documents in blocks of about ``block_tokens``, so it never holds more
    than a block and one document. ``sequence_id`` is the range's number and the sequence's in it.
    """
    schema = StructType.fromDDL(PIECES + (", ids binary" if with_ids else ""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enders, kind = sentence_enders(encoder(tokenizer).tokenizer), f"<u{id_bytes(tokenizer, end_id)}"
        sequence = TaskContext.get().partitionId() << 40
        names, held, n_held = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal sequence
            ids, lengths = np.concatenate(held), np.array([len(x) for x in held], np.int64)
            doc_ends = np.cumsum(lengths)
            pos, penalty = cuts(doc_ends, np.flatnonzero(enders[ids]) + 1, window, sentence_cut, hard_cut)
            ends = plan(pos, penalty, window, exact_from)
            edges = np.unique(np.concatenate([[0], doc_ends, ends]))
            first, last = edges[:-1], edges[1:]
            doc, seq = np.searchsorted(doc_ends, first, "right"), np.searchsorted(ends, first, "right")
            seq_start = np.concatenate([[0], ends])[seq]
            body = memoryview(ids.tobytes())
            out = {
                "doc_id": pa.array([names[d] for d in doc.tolist()], pa.int64()),
                "start": pa.array(first - (doc_ends - lengths)[doc], pa.int64()),
                "length": pa.array(last - first, pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(body[4 * a : 4 * b]) for a, b in zip(first.tolist(), last.tolist(), strict=True)], pa.int64()),
                "doc_tokens": pa.array(lengths[doc], pa.int64()),
                "sequence_id": pa.array(sequence + seq, pa.int64()),
                "offset": pa.array(first - seq_start, pa.int64()),
            }
            if with_ids:
                out["ids"] = pa.array([bytes(body[4 * a : 4 * b]) for a, b in zip(first.tolist(), last.tolist(), strict=True)], pa.binary())
            sequence += len(ends)
            return pa.RecordBatch.from_pydict(out)

        for batch in batches:
            for doc_id, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.frombuffer(body.as_buffer(), kind).astype("<u4")
                names.append(doc_id)
                held.append(ids)
                n_held += len(ids)
                if n_held >= block_tokens:
                    yield flush()
                    names, held, n_held = [], [], 0
        if held:
            yield flush()

    return common.map_arrow(encoded(docs, tokenizer, end_id), run, schema)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` packed into sequences of at most 4096 tokens, a row a piece; null, empty, very long, repeated and missing rows as the module states."""
    return pack(common.table(spark, sf_dir, "documents"), "word_bpe_49k.json", end_id=2)
