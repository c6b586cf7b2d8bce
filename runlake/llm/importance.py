"""Quality by importance resampling.

Two generative models of hashed n-grams are fitted: *raw*, the whole corpus, and *target*, the
labelled documents that are good. A document's log importance weight is the sum over its n-grams of
the log ratio of the two, and documents are drawn without replacement by Gumbel top-k: a document's
key is its log weight, divided by the temperature (1), plus Gumbel noise, and the k largest keys are
taken. k is the target size: ``share`` of all rows, by default the part of the labelled documents
that is good. So the draw has the inclusion probabilities of sampling in proportion to the weights,
and a document near the limit is in with one seed and out with another.

The models: a text is a set of n-grams, each present or not. Raw's chance of an n-gram is its share
of all texts. Target is sparse and additive over raw: the log of its chance is raw's plus a
deviation that is zero unless the labels show otherwise, namely the log of seen over expected count,
drawn towards zero by ``SHRINK`` standard errors and a ``MARGIN`` (the estimate under a Laplace prior).
Raw holds target, so no n-gram of ordinary good text deviates by more than log(raw / good); without the
prior the small errors of all ordinary words outweigh, in a long document, the few words that tell.

N-grams: words, word pairs, the first four letters of words, word shapes (letters and digits as A,
a, 0, runs shortened, other marks as they are) alone and in pairs, and a word's own repetition (one
for each power of two that its longest run in a row exceeds). Each kind is hashed into buckets of its
own, whose number grows with the square root of the corpus's length (``sizes_for``).

The target model comes from the labels (bound: ``most_labelled`` documents, chosen by a hash of
doc_id); raw counts, weights, k and the selection cover all documents. Noise comes from a hash of
doc_id and a seed, so that reruns agree.

Defined cases: without usable labels every weight is zero and all documents are kept; null text is
empty and has weight zero; null doc_ids share one noise value; rows with the k-th key are all kept,
so repeated rows stay together; labels repeated for a document count as good only if all are; labels
without documents are ignored; an empty table gives no rows; extra columns stay, whatever their names.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from runlake.llm import common

SHRINK, MARGIN = 3.0, 0.6
_SHAPES = re.compile(r"[^\W\d_]+|[0-9]+")
_REPEATED = re.compile(r"(.)\1+")
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_ENDS = ".,;:!?"
RUNS = 16  #: buckets of the last kind, a word's own repetition
BLOCK = 1 << 12  #: buckets whose counts travel as one row


def sizes_for(chars: int) -> tuple[int, ...]:
    """Buckets for words, word beginnings, word pairs, shapes and runs in a corpus of so many characters: 2^18 words up to about 200 million of them, twice as many for each fourfold, 2^22 at most."""
    words = 1 << min(22, max(18, round(math.log2(18 * math.sqrt(max(1, chars))))))
    return words, words >> 2, words, 1 << 14, RUNS


class Buckets:
    """Where each kind's buckets begin."""

    def __init__(self, sizes: tuple[int, ...]) -> None:
        self.sizes, self.total = sizes, sum(sizes)
        self.starts = tuple(sum(sizes[:k]) for k in range(len(sizes)))

    def of(self, hashes: np.ndarray, kind: int) -> np.ndarray:
        h = (hashes ^ (hashes >> np.uint64(29))) * _MULTIPLY
        return ((h ^ (h >> np.uint64(32))) % np.uint64(self.sizes[kind])).astype(np.int64) + self.starts[kind]


def _cased(letters: str) -> str:
    if letters.islower():
        return "a"
    return "AA" if letters.isupper() and len(letters) > 1 else "Aa"


def _shape(word: str) -> str:
    """Letters as a, Aa or AA, digits as 0, other marks as they are, at most two of a kind."""
    bare = word.rstrip(_ENDS)
    if bare.isalpha():
        return _cased(bare) + _REPEATED.sub(r"\1\1", word[len(bare) :])[:8] if len(bare) < len(word) else _cased(bare)
    out = _SHAPES.sub(lambda m: "0" if m[0].isdecimal() else _cased(m[0]), word[:64])
    return _REPEATED.sub(r"\1\1", out)[:12]


class Words(dict):
    """Word to its row in three lists of hashes: of itself, its beginning and its shape. Starts afresh when full."""

    def __init__(self, most: int = 300_000) -> None:
        super().__init__()
        self.most, self.parts = most, ({}, {})
        self.lists = (array("Q"), array("Q"), array("Q"))

    def _part(self, kind: int, text: str) -> int:
        """The hash of a beginning or a shape, of which there are few."""
        held = self.parts[kind]
        found = held.get(text)
        if found is None:
            if len(held) >= 100_000:
                held.clear()
            found = held[text] = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), kind + 1)
        return found

    def __missing__(self, word: str) -> int:
        bare = word.lower()
        if bare == word and word.isalpha():
            shape = "a"
        else:
            bare, shape = bare.strip(_ENDS), _shape(word)
        whole, start, form = self.lists
        whole.append(xxhash.xxh64_intdigest(bare.encode("utf-8", "surrogatepass"), 0))
        start.append(self._part(0, bare[:4]))
        form.append(self._part(1, shape))
        self[word] = row = len(whole) - 1
        return row

    def hashes(self, words: list[str]) -> list[np.ndarray]:
        """The three hashes of each word, in portions, between which the lists may start afresh."""
        out = [[], [], []]
        for at in range(0, len(words), self.most):
            part = words[at : at + self.most]
            if len(self) > self.most:
                self.clear()
                self.lists = (array("Q"), array("Q"), array("Q"))
            rows = np.array(list(map(self.__getitem__, part)), np.int32)
            for own, held in zip(out, self.lists, strict=True):
                own.append(np.array(held, np.uint64)[rows])
        return [np.concatenate(own) for own in out]


def _once(keys: np.ndarray) -> np.ndarray:
    """Sorted, each once."""
    keys = np.sort(keys)
    return keys[np.r_[True, keys[1:] != keys[:-1]]] if len(keys) else keys


def features(texts: list[str | None], known: Words, buckets: Buckets) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket) of the texts' n-grams, each once a text, and the texts' numbers of words."""
    split = [t.split() if t else [] for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    if not sizes.sum():
        return np.empty(0, np.int64), np.empty(0, np.int64), sizes
    word, start, shape = known.hashes([w for own in split for w in own])
    text = np.repeat(np.arange(len(texts)), sizes)
    inside = text[1:] == text[:-1]  # pairs don't cross texts
    key = lambda of, bucket: _once(of * buckets.total + bucket)
    pair = (word[:-1] * np.uint64(3) + word[1:])[inside]
    shapes = (shape[:-1] * np.uint64(5) + shape[1:] + np.uint64(11))[inside]
    ends = np.flatnonzero(np.r_[True, ~inside | (word[1:] != word[:-1]), True])
    runs, run_text = np.diff(ends), text[ends[:-1]]
    keys = [key(text, buckets.of(word, 0)), key(text, buckets.of(start, 1)), key(text[1:][inside], buckets.of(pair, 2)), key(text, buckets.of(shape, 3)), key(text[1:][inside], buckets.of(shapes, 3))]
    for level in range(1, RUNS):
        long = run_text[runs > 1 << level]
        if not len(long):
            break
        keys.append(key(long, buckets.starts[4] + level))
    keys = np.concatenate(keys)
    return keys // buckets.total, keys % buckets.total, sizes


def _count(batches: Iterator[pa.RecordBatch], buckets: Buckets) -> Iterator[pa.RecordBatch]:
    """(text, good) to the counts of the buckets in all of a partition's texts and in its good ones, a row for each ``BLOCK`` of them, packed."""
    known, raw, target = Words(), np.zeros(buckets.total, "<i4"), np.zeros(buckets.total, "<i4")
    for batch in common.slices(batches):
        good = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), bool)
        text, bucket, _ = features(batch.column(0).to_pylist(), known, buckets)
        for counts, own in ((raw, bucket), (target, bucket[good[text]])):
            at, n = np.unique(own, return_counts=True)
            counts[at] += n.astype(np.int32)
    pack = zstandard.ZstdCompressor(level=1).compress
    held = [at for at in range(0, buckets.total, BLOCK) if raw[at : at + BLOCK].any()]
    yield pa.RecordBatch.from_pydict({"block": pa.array([at // BLOCK for at in held], pa.int32()), **{name: pa.array([pack(counts[at : at + BLOCK].tobytes()) for at in held], pa.binary()) for name, counts in (("raw", raw), ("target", target))}})


def _telling(batches: Iterator[pa.RecordBatch], n_raw: int, n_target: int) -> Iterator[pa.RecordBatch]:
    """Blocks of counts to the deviations that aren't zero; holds the sums of the partition's blocks."""
    unpack, sums = zstandard.ZstdDecompressor().decompress, {}
    for batch in batches:
        for block, raw, target in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            more = np.stack([np.frombuffer(unpack(x), "<i4") for x in (raw, target)]).astype(np.int64)
            sums[block] = sums[block] + more if block in sums else more
    for block, (raw, target) in sums.items():
        d = deviation(raw, target, n_raw, n_target)
        at = np.flatnonzero(d)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at + block * BLOCK, pa.int64()), "d": pa.array(d[at], pa.float64())})


def deviation(raw: np.ndarray, target: np.ndarray, n_raw: int, n_target: int) -> np.ndarray:
    """Per bucket: target's log chance less raw's, under the prior."""
    expected = raw * (n_target / n_raw)  # what raw's share makes one expect of target
    ratio = np.log((target + 0.5) / (expected + 0.5))
    return np.sign(ratio) * np.maximum(0, np.abs(ratio) - SHRINK / np.sqrt(expected + 0.5) - MARGIN)


class Model:
    """The buckets and the deviations of those whose deviation isn't zero, by bucket."""

    def __init__(self, buckets: Buckets, at: np.ndarray, log_ratio: np.ndarray) -> None:
        order = np.argsort(at)
        self.buckets, self.at, self.log_ratio = buckets, at[order], log_ratio[order]

    def weights(self, texts: list[str | None], known: Words) -> tuple[np.ndarray, np.ndarray]:
        """The texts' log weights, rounded to a millionth, and their numbers of words."""
        text, bucket, sizes = features(texts, known, self.buckets)
        if not len(self.at):
            return np.zeros(len(texts)), sizes
        place = np.minimum(np.searchsorted(self.at, bucket), len(self.at) - 1)
        hit = self.at[place] == bucket
        return np.round(np.bincount(text[hit], self.log_ratio[place[hit]], minlength=len(texts)), 6) + 0.0, sizes


def labelled(docs: DataFrame, labels: DataFrame, most_labelled: int, good: str) -> DataFrame:
    """``docs`` with a column ``good``: true or false for the labelled documents of the bounded sample, else null."""
    (label_id,) = common.spare([*docs.columns, good], "label_id")
    sound = (F.coalesce("quality", F.lit(0)) == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    one = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias(label_id)).agg(F.min(sound).alias(good))
    n = labels.count()
    if n > most_labelled:
        one = one.where(F.pmod(F.xxhash64(label_id), F.lit(1 << 20)) < int((1 << 20) * most_labelled / n))
    return docs.join(F.broadcast(one), F.col("doc_id").cast("long") == F.col(label_id), "left").drop(label_id)  # at most about most_labelled rows of two short columns


def fit(marked: DataFrame, good: str) -> tuple[Model, float]:
    """The model from all rows of ``marked`` (text, and the mark ``good``), and the part of the marked ones that is good (1 if none is marked)."""
    told = marked.agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("rows"), F.count(good).alias("n"), F.sum(F.col(good).cast("long")).alias("good")).first()
    buckets = Buckets(sizes_for(told.chars or 0))
    if not told.good:
        return Model(buckets, np.empty(0, np.int64), np.empty(0)), 1.0
    counts = common.map_arrow(marked.select("text", F.coalesce(good, F.lit(False)).alias("good")), lambda b: _count(b, buckets), "block int, raw binary, target binary")
    found = common.map_arrow(counts.repartition("block"), lambda b: _telling(b, told.rows, told.good), "bucket long, d double").toArrow()  # fewer rows than buckets, and those are bounded
    return Model(buckets, found.column("bucket").to_numpy(), found.column("d").to_numpy()), told.good / told.n


def weigh(docs: DataFrame, model: Model, weight: str, n_words: str) -> DataFrame:
    """All columns of ``docs``, and the log weight and number of words of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as many numbers as buckets, at most
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = shared.value, Words()
        for batch in common.slices(batches):
            weights, words = own.weights(batch.column(at).to_pylist(), known)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(weights, pa.float64()), pa.array(words, pa.int64())], [*batch.schema.names, weight, n_words])

    schema = StructType([*docs.schema.fields, StructField(weight, DoubleType()), StructField(n_words, LongType())])
    return common.map_arrow(docs, run, schema)


def kth_largest(keys: DataFrame, k: int, few: int = 20_000, bins: int = 2048) -> float:
    """The k-th largest ``key`` (a double, from 1), by narrowing histograms; only a last bin of at most ``few`` rows comes to the driver."""
    low, high, n = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if not n or k >= n:
        return low if low is not None else -math.inf
    within, width = keys, n
    while width > few and high > low:
        step = (high - low) / bins
        bin_ = F.least(F.lit(bins - 1), F.floor((F.col("key") - low) / step)).cast("int")
        rows = {r.bin: r for r in within.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).collect()}
        for b in sorted(rows, reverse=True):
            if rows[b].n >= k:
                break
            k -= rows[b].n
        low, high, width = rows[b].low, rows[b].high, rows[b].n
        within = keys.where(F.col("key").between(low, high))
    return low if high == low else sorted((r.key for r in within.select("key").collect()), reverse=True)[k - 1]


def noise(seed: int) -> F.Column:
    """Gumbel noise from a hash of doc_id."""
    unit = (F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(unit))


def limit_of(weighted: DataFrame, key: F.Column, share: float) -> float:
    """The smallest key among the ``share`` of the rows with the largest keys."""
    k = round(weighted.count() * share)
    return kth_largest(weighted.select(key.alias("key")), k) if k else math.inf


def draw(docs: DataFrame, labels: DataFrame, share: float | None, temperature: float, most_labelled: int, seed: int, names: tuple[str, str], drop: tuple[str, ...] = ()) -> tuple[DataFrame, F.Column, float]:
    """``docs`` but for ``drop``, with log weights and numbers of words (columns ``names``), written once; the key, and the smallest one that is drawn."""
    model, part = fit(labelled(docs.select("doc_id", "text"), labels, most_labelled, "good"), "good")
    weighted = common.materialise(docs.sparkSession, weigh(docs, model, *names).drop(*drop), "weights")
    key = F.col(names[0]) / temperature + noise(seed)
    return weighted, key, limit_of(weighted, key, part if share is None else share)


def select(docs: DataFrame, labels: DataFrame, share: float | None = None, temperature: float = 1.0, most_labelled: int = 200_000, seed: int = 17) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, log_weight, n_words, key, kept."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    weighted, key, limit = draw(slim, labels, share, temperature, most_labelled, seed, ("log_weight", "n_words"), ("text",))
    return weighted.withColumns({"key": key, "kept": key >= limit})


def keep(docs: DataFrame, labels: DataFrame, share: float | None = None, temperature: float = 1.0, most_labelled: int = 200_000, seed: int = 17) -> DataFrame:
    """The rows of ``docs`` that the resampling draws, with all their columns."""
    names = tuple(common.spare(docs.columns, "log_weight", "n_words"))
    weighted, key, limit = draw(docs, labels, share, temperature, most_labelled, seed, names)
    return weighted.where(key >= limit).select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance resampling of all ``documents`` by ``labels``: doc_id, log_weight, n_words, key, kept; null, empty, tied, repeated and missing rows as the module states."""
    return select(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
