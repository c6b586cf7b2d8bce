"""Benchmark decontamination by a prefix-filtered join with exact verification.

A window is 13 consecutive words of an item (an item of fewer, but not none, is one window). Its
words are ordered by rarity in the whole corpus, rarest first. A document contains a window only if
it contains the window's prefix, which for whole containment is its one rarest word. So documents
probe an index from rare words to (window, offset of the word); the offset fixes where the window
would start (positional bound) and both ends must lie in the document (length bound); what is left
is verified word by word.

The index holds the benchmark's words and windows. It is broadcast if the benchmark has at most
``most_words`` words; a larger one is worked through in blocks of items of that size. Then only documents
with hits leave a block's pass, and their hits are united afterwards.

Defined cases: null or wordless documents have no words and no hits and aren't contaminated; null or
wordless items match nothing; repeated rows of an item count once; an item with null item_id counts
under the empty name; repeated documents are judged row by row; empty tables give no rows or no hits;
extra columns of documents, whatever their names, are kept by ``clean`` and ignored by ``judge``.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlake.llm import common

WINDOW = 13
JUDGED = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
HITS = "row_id string, doc_id long, n_words long, starts array<int>, ends array<int>, items array<string>"

#: Bytes to words: A-Z lower-cased; 0-9, a-z and everything from 0x80 on are letters; the rest separates.
_WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split() if text else []


class Vocabulary(dict):
    """Word to number from 1 on; words that the benchmark lacks are 0."""

    def __missing__(self, word: bytes) -> int:
        return 0


def numbered(texts: list[str | None], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """All words' numbers, document after document, and each document's first position (one more at the end)."""
    numbers, ends = [], [0]
    for text in texts:
        if text:
            own = list(map(vocabulary.__getitem__, text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()))
            numbers.append(np.array(own, np.int32))
            ends.append(ends[-1] + len(own))
        else:
            ends.append(ends[-1])
    return np.concatenate(numbers) if numbers else np.empty(0, np.int32), np.array(ends)


def _alike(words: np.ndarray, window: int) -> np.ndarray:
    """For each place a number below 2^31 that equal windows of ``window`` words from there, and no others, share (the last ``window`` - 1 places have none).

    Stretches of a power of two are numbered in pairs of half their length; the window is put together from them."""
    out, done, stretch, size = None, 0, words.astype(np.int64), 1
    while done < window:
        if window & size:
            own = stretch[done:]
            out = own if out is None else np.unique(out[: len(own)] << 32 | own, return_inverse=True)[1]
            done += size
        if done < window:
            stretch = np.unique(stretch[: max(0, len(stretch) - size)] << 32 | stretch[size:], return_inverse=True)[1]
            size *= 2
    return out


class Index:
    """Windows by their rarest word."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> None:
        self.vocabulary, self.width = Vocabulary(), window
        self.names = sorted({name for name, _ in items})
        number = {name: k for k, name in enumerate(self.names)}
        owner, sizes = np.array([number[name] for name, own in items if own], np.int64), np.array([len(own) for _, own in items if own], np.int64)
        room = np.maximum(sizes, window)  # short items are filled up with 0, which is no word's number
        begin = np.cumsum(room) - room
        #: All items' words in a row; a window is where it begins.
        self.words = np.zeros(int(room.sum()), np.int32)
        for at, own in zip(begin.tolist(), (own for _, own in items if own), strict=True):
            self.words[at : at + len(own)] = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in own]
        times = room - window + 1
        start = np.repeat(begin, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        item = np.repeat(owner, times)
        _, once = np.unique(item << 32 | _alike(self.words, window)[start], return_index=True)
        once.sort()
        self.item, self.begin, self.length = item[once], start[once], np.repeat(np.minimum(sizes, window), times)[once]

    def order(self, counts: np.ndarray) -> "Index":
        """Choose each window's prefix by the corpus counts of the words (indexed by number)."""
        n = len(self.item)
        self.offset, least = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max)
        for k in range(self.width if n else 0):
            rarer = np.flatnonzero((k < self.length) & (counts[self.words[self.begin + k]] < least))
            self.offset[rarer], least[rarer] = k, counts[self.words[self.begin[rarer] + k]]
        prefix = self.words[self.begin + self.offset]
        self.sorted = np.argsort(prefix, kind="stable")
        self.first = np.searchsorted(prefix[self.sorted], np.arange(len(self.vocabulary) + 2))
        return self

    def occurrences(self, ids: np.ndarray, ends: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, start) of every occurrence, in bounded portions."""
        many = self.first[ids + 1] - self.first[ids]
        at = np.flatnonzero((many > 0) & (ids > 0))
        total = np.cumsum(many[at])
        done = 0
        while done < len(at):
            upto = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + most, "right")))
            here = at[done:upto]
            done, times = upto, many[here]
            position = np.repeat(here, times)
            window = self.sorted[np.repeat(self.first[ids[here]], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
            start = position - self.offset[window]
            doc = np.searchsorted(ends, position, "right") - 1
            fits = (start >= ends[doc]) & (start + self.length[window] <= ends[doc + 1])
            window, start = window[fits], start[fits]
            for k in range(self.width):
                same = (self.length[window] <= k) | (ids[np.minimum(start + k, len(ids) - 1)] == self.words[self.begin[window] + k])
                window, start = window[same], start[same]
            if len(start):
                yield window, start


def _counts(docs: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """How often each benchmark word occurs in the whole corpus."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        sums = np.zeros(len(known) + 1, np.int64)
        for batch in common.slices(batches):
            sums += np.bincount(numbered(batch.column(0).to_pylist(), known)[0], minlength=len(sums))
        at = np.flatnonzero(sums[1:]) + 1
        yield pa.RecordBatch.from_pydict({"word": pa.array(at, pa.int64()), "n": pa.array(sums[at], pa.int64())})

    out = np.zeros(len(vocabulary) + 1, np.int64)
    for row in common.map_arrow(docs.select("text"), run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
        out[row.word] = row.n
    return out


def blocks(benchmark: DataFrame, most_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items in blocks of at most about ``most_words`` words, streamed to the driver a partition at a time."""
    held, n = [], 0
    for row in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), "text").toLocalIterator():
        own = words(row.text)
        if own:
            held.append((row.name, own))
            n += len(own)
        if n > most_words:
            yield held
            held, n = [], 0
    if held:
        yield held


def _probe(docs: DataFrame, items: list[tuple[str, list[bytes]]], give: str) -> DataFrame:
    """One pass over ``docs``; ``give``: verdicts, hits (of rows that have some, with row_id), or the clean rows with all their columns."""
    index = Index(items)
    shared = docs.sparkSession.sparkContext.broadcast(index.order(_counts(docs, index.vocabulary)))
    if give != "clean":
        docs = docs.select(F.col("doc_id").cast("long"), "text", *(["row_id"] if give == "hits" else []))
    text, doc_id = docs.columns.index("text"), docs.columns.index("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in common.slices(batches):
            ids, ends = numbered(batch.column(text).to_pylist(), index.vocabulary)
            n = batch.num_rows
            edge, pairs, spans = np.zeros(len(ids) + 1, np.int64), [], []
            for window, start in index.occurrences(ids, ends):
                np.add.at(edge, start, 1)
                np.add.at(edge, start + index.length[window], -1)
                doc = np.searchsorted(ends, start, "right") - 1
                pairs.append(np.unique(doc * len(index.names) + index.item[window]))
                spans.append(np.stack([doc, start - ends[doc], start - ends[doc] + index.length[window]]))
            hit = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
            n_words, n_hit = np.diff(ends), hit[ends[1:]] - hit[ends[:-1]]
            found: list[list[str]] = [[] for _ in range(n)]
            for p in np.unique(np.concatenate(pairs)).tolist() if pairs else []:
                found[p // len(index.names)].append(index.names[p % len(index.names)])
            if give == "clean":
                yield batch.filter(pa.array((n_hit == 0) | (20 * n_hit < n_words)))
            elif give == "hits":
                starts: list[list[int]] = [[] for _ in range(n)]
                stops: list[list[int]] = [[] for _ in range(n)]
                for d, a, b in np.unique(np.concatenate(spans, axis=1), axis=1).T.tolist() if spans else []:
                    starts[d].append(a)
                    stops[d].append(b)
                all_ = pa.RecordBatch.from_pydict({"row_id": batch.column(2), "doc_id": batch.column(doc_id), "n_words": pa.array(n_words, pa.int64()), "starts": pa.array(starts, pa.list_(pa.int32())), "ends": pa.array(stops, pa.list_(pa.int32())), "items": pa.array(found, pa.list_(pa.string()))})
                yield all_.filter(pa.array(n_hit > 0))
            else:
                yield _verdicts(batch.column(doc_id), n_words, n_hit, found)

    return common.map_arrow(docs, run, {"clean": docs.schema, "hits": HITS, "verdicts": JUDGED}[give])


def _verdicts(doc_ids: pa.Array, n_words: np.ndarray, n_hit: np.ndarray, found: list[list[str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "doc_id": doc_ids,
        "n_words": pa.array(n_words, pa.int64()),
        "n_hit": pa.array(n_hit, pa.int64()),
        "n_items": pa.array([len(x) for x in found], pa.int64()),
        "items_sha256": [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in found],
        "contaminated": pa.array((n_hit > 0) & (20 * n_hit >= n_words), pa.bool_()),
    })


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the hits of all blocks (arrays of arrays) to verdicts, after their row_id."""
    for batch in batches:
        n_hit, found = [], []
        for starts, ends, items in zip(*(batch.column(k).to_pylist() for k in (3, 4, 5)), strict=True):
            covered, end = 0, 0
            for a, b in sorted((a, b) for s, e in zip(starts, ends, strict=True) for a, b in zip(s, e, strict=True)):
                covered += max(0, b - max(a, end))
                end = max(end, b)
            n_hit.append(covered)
            found.append(sorted({x for own in items for x in own}))
        told = _verdicts(batch.column(1), np.asarray(batch.column(2)), np.array(n_hit, np.int64), found)
        yield pa.RecordBatch.from_arrays([batch.column(0), *told.columns], ["row_id", *told.schema.names])


def _in_blocks(rows: DataFrame, parts: Iterator[list[tuple[str, list[bytes]]]]) -> DataFrame:
    """Verdicts on the rows (doc_id, text, row_id) that have hits, from one pass for each block of the benchmark."""
    hits = None
    for items in parts:
        one = common.materialise(rows.sparkSession, _probe(rows, items, "hits"), "decontaminate-hits")
        hits = one if hits is None else hits.union(one)
    #: At most one row for each block and document, so a group has as many rows as there are blocks.
    joined = hits.groupBy("row_id").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.collect_list("starts").alias("starts"), F.collect_list("ends").alias("ends"), F.collect_list("items").alias("items"))
    return common.map_arrow(joined, _unite, "row_id string, " + JUDGED)


def _unhit(rows: DataFrame) -> DataFrame:
    """Verdicts on the rows as if they had no hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            n_words = np.array([len(words(t)) for t in batch.column(1).to_pylist()], np.int64)
            told = _verdicts(batch.column(0), n_words, n_words * 0, [[]] * batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(2), *told.columns], ["row_id", *told.schema.names])

    return common.map_arrow(rows, run, "row_id string, " + JUDGED)


def _apply(docs: DataFrame, benchmark: DataFrame, most_words: int, give: str) -> DataFrame:
    parts = blocks(benchmark, most_words)
    first, second = next(parts, []), next(parts, None)
    if second is None:
        return _probe(docs, first, give)
    (own,) = common.spare(docs.columns, "row_id")
    rows = common.materialise(docs.sparkSession, docs.withColumn(own, F.expr("uuid()")), "decontaminate-rows")
    slim = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(own).alias("row_id"))
    told = common.materialise(docs.sparkSession, _in_blocks(slim, itertools.chain([first, second], parts)), "decontaminate-told")
    if give == "verdicts":
        return told.unionByName(_unhit(slim.join(told, "row_id", "left_anti").select("doc_id", "text", "row_id"))).drop("row_id")
    bad = told.where("contaminated").select(F.col("row_id").alias(own))
    return rows.join(bad, own, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def judge(docs: DataFrame, benchmark: DataFrame, most_words: int = 2_000_000) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return _apply(docs.select("doc_id", "text"), benchmark, most_words, "verdicts")


def clean(docs: DataFrame, benchmark: DataFrame, most_words: int = 2_000_000) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with all their columns."""
    return _apply(docs, benchmark, most_words, "clean")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` judged by the whole ``benchmark``; null, wordless, repeated and missing rows as the module states."""
    return judge(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, i, dw.n AS n FROM dw JOIN win USING (n, s)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id)), ',') AS names FROM hit GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
