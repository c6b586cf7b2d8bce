"""Toxicity by a factorization machine over hashed terms.

A text's terms are its words (runs of letters, lower-cased) and their beginnings of 4 to 7 letters, each known by a 64-bit
hash and each present or not. Texts are read many at once: each different word of a batch is looked at once (``terms_in``, ``numbers_in``),
terms are told apart by what they spell, and only those that may come into the model are hashed. With x the set of the model's terms that a text has, its score is the logistic function of

    bias + sum of w[i] + sum over pairs i < j of <v[i], v[j]>

so two terms can count together, such as an insult with a mention of a group, where neither tells alone; the pairs
cost no more than the terms, being half the difference of the squared sum and the sum of squares of the factors.

What is learned:
1. *Terms.* For each term of the labelled documents, how far its toxic documents are from what its documents in all make one
   expect, in standard errors. The ``terms`` terms furthest off (``FAR`` or more, in ``few`` documents or more) make the model; the
   others weigh nothing, however many there are, so long texts don't drift by the errors of their ordinary words.
2. *Weights and factors*, in ``rounds`` rounds of full gradients. A round is one Spark job over the labelled documents' terms,
   kept in ``shards`` partitions, from which only sums come to the driver, of a size that the model sets. Steps are scaled by
   curvature and by how many terms share a text. Weights move with momentum, under a Laplace prior of ``PRIOR`` standard
   errors. Factors follow after a third of the rounds: those whose gradient exceeds ``SURE`` standard errors move, the
   others fade from their small random start, so pairs count only where they tell something that weights don't.

Learning reads a bounded sample of labels (``most_labelled``, by a hash of doc_id), and of them only rows whose crc32(doc_id as text) mod 5
isn't 0. Scores read every whole text, and nothing but the text.

Defined cases: null text is empty; a text without the model's terms has the bias's score; without labels of both kinds every score is 0
(1, if all are toxic); labels of null doc_id or null toxic are ignored, repeated ones count as toxic if one is; documents with null
doc_id are never learned from and not held out; repeated rows are learned from and scored each for itself; an empty
table gives no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlake.llm import common

BEGINNINGS = (4, 5, 6, 7)
FAR, PRIOR, SURE, START, FADE, FLAT, LARGEST_STEP = 2.5, 0.6, 1.5, 0.05, 0.9, 0.02, 0.5
_WORDS = re.compile(r"[^\W\d_]+")
_NO_LETTERS = {c: " " for c in range(128) if not chr(c).isalpha()}
_AT_ONCE, _ROWS = 1_000_000, 20_000  # words whose terms are counted at once; rows of a batch of counts


def _hash(kind: str, text: str) -> int:
    return xxhash.xxh64_intdigest((kind + text).encode("utf-8", "surrogatepass")) - (1 << 63)  # as a signed number


def terms_of(word: str) -> tuple[int, ...]:
    """The hashes of a word's terms."""
    return (_hash("w", word), *(_hash("b", word[:n]) for n in BEGINNINGS if n <= len(word)))


def words_of(text: str | None) -> set[str]:
    """A text's different words."""
    if not text:
        return set()
    return set(text.lower().translate(_NO_LETTERS).split()) if text.isascii() else set(_WORDS.findall(text.lower()))


def words_in(texts: list[str | None]) -> tuple[pa.Array, np.ndarray]:
    """The texts' different words, one text after the other, and how many each has."""
    each = [words_of(t) for t in texts]
    return pa.array([w for own in each for w in own], pa.large_string()), np.fromiter(map(len, each), np.int64, len(each))


def _spelled(kind: str, words: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(pa.scalar(kind, words.type), words, pa.scalar("", words.type))


def _once(numbers: np.ndarray) -> np.ndarray:
    """Sorted, each once. (numpy's ``unique`` hashes, at many times the cost.)"""
    numbers = np.sort(numbers)
    return numbers[np.r_[True, numbers[1:] != numbers[:-1]]] if len(numbers) else numbers


def terms_in(words: pa.Array, sizes: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Of texts by their different words: for each kind of term the different terms, spelled after their kind, and pairs of a text's number and a term's, each once."""
    coded = words.dictionary_encode()
    known, code, text = coded.dictionary, coded.indices.to_numpy(), np.repeat(np.arange(len(sizes)), sizes)
    yield _spelled("w", known), text, code
    lengths = pc.utf8_length(known)
    for n in BEGINNINGS:
        begun = pc.if_else(pc.greater_equal(lengths, n), pc.utf8_slice_codeunits(known, 0, n), pa.scalar(None, known.type)).dictionary_encode()
        own = begun.indices.fill_null(-1).to_numpy()[code]
        many = max(1, len(begun.dictionary))
        pairs = _once((text * many + own)[own >= 0])
        yield _spelled("b", begun.dictionary), pairs // many, pairs % many


def numbers_in(words: pa.Array, sizes: np.ndarray, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of texts by their different words: the numbers of their terms among ``names``, ascending in each text, and where each text begins (and the last ends)."""
    coded = words.dictionary_encode()
    known, code, text, many = coded.dictionary, coded.indices.to_numpy(), np.repeat(np.arange(len(sizes)), sizes), max(1, len(names))
    found = [np.empty(0, np.int64)]
    for spelled in (_spelled("w", known), *(_spelled("b", pc.utf8_slice_codeunits(known, 0, n)) for n in BEGINNINGS)):  # a shorter word's are none, or its own
        own = pc.index_in(spelled, value_set=names).fill_null(-1).to_numpy()[code]
        found.append((text * many + own)[own >= 0])
    pairs = _once(np.concatenate(found))
    return pairs % many, np.searchsorted(pairs, np.arange(len(sizes) + 1) * many)


class Terms(dict):
    """Word to its terms' hashes (or their numbers in the model), computed once a word. Starts afresh when full. The plain form of what ``terms_in`` and ``numbers_in`` do for many texts."""

    def __init__(self, numbers: dict[int, int] | None = None, most: int = 100_000) -> None:
        super().__init__()
        self.numbers, self.most = numbers, most

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= self.most:
            self.clear()
        own = terms_of(word)
        if self.numbers is not None:
            own = tuple(self.numbers[h] for h in own if h in self.numbers)
        self[word] = own
        return own

    def of(self, text: str | None) -> set[int]:
        return {h for word in set(_WORDS.findall(text.lower())) for h in self[word]} if text else set()


def csr(each: list[set[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Sets of numbers as one array, and where each begins (and the last ends)."""
    sizes = np.fromiter(map(len, each), np.int64, len(each))
    return np.fromiter((x for own in each for x in sorted(own)), np.int64, int(sizes.sum())), np.r_[0, np.cumsum(sizes)]


def sums_of(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The sums of each stretch of rows."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0)])
    return total[ends[1:]] - total[ends[:-1]]


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Machine:
    """hashes[term], weights[term], factors[term]; spread: the variance that chance gives a term's toxic documents; before: the weights
    without their momentum; ``losses``: the log loss before each round; names: how the terms are spelled, after their kind."""

    hashes: np.ndarray
    spread: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    before: np.ndarray
    bias_before: float
    losses: list[float] = field(default_factory=list)
    names: np.ndarray = field(default_factory=lambda: np.empty(0, object))

    @classmethod
    def start(cls, hashes: np.ndarray, counts: np.ndarray, toxic: int, n: int, rank: int, seed: int) -> "Machine":
        rng = np.random.default_rng(seed)
        part = toxic / n
        bias = float(np.log((toxic + 0.5) / (n - toxic + 0.5)))
        return cls(hashes, counts * part * (1 - part), bias, np.zeros(len(hashes)), rng.normal(0, START, (len(hashes), rank)), np.zeros(len(hashes)), bias)

    def logits(self, at: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of texts given by their terms' numbers: logits, and the sums of their terms' factors."""
        v = self.factors[at]
        s = sums_of(v, ends)
        return self.bias + sums_of(self.weights[at], ends) + 0.5 * ((s * s).sum(axis=1) - sums_of((v * v).sum(axis=1), ends)), s

    def gradient(self, at: np.ndarray, ends: np.ndarray, toxic: np.ndarray) -> np.ndarray:
        """Sums over these texts, flat: loss, the bias's gradient and curvature; then for the weights, and for each factor: gradient, curvature, and curvature shared by the text's terms."""
        logits, s = self.logits(at, ends)
        p = logistic(logits)
        off, curve, sizes = toxic - p, np.maximum(p * (1 - p), FLAT), np.diff(ends)
        text, n, rank = np.repeat(np.arange(len(toxic)), sizes), len(self.weights), self.factors.shape[1]
        loss = -np.log(np.clip(np.where(toxic == 1, p, 1 - p), 1e-12, 1)).sum()
        out = [np.array([loss, off.sum(), (curve * (1 + sizes)).sum()])]
        c, o, many = curve[text], off[text], (curve * (1 + sizes))[text]
        out += [np.bincount(at, x, n) for x in (o, c, many)]
        for f in range(rank):
            rest = s[text, f] - self.factors[at, f]
            out += [np.bincount(at, x, n) for x in (o * rest, c * rest * rest, many * rest * rest)]
        return np.concatenate(out)

    def moved(self, sums: np.ndarray, pairs: bool) -> "Machine":
        """After a round; factors move only if ``pairs``."""
        n, rank = self.factors.shape
        table = sums[3:].reshape(1 + rank, 3, n)
        g, _, many = table[0]
        many, penalty = many + 1, PRIOR * np.sqrt(self.spread)
        w = self.weights + np.clip(g / many, -LARGEST_STEP, LARGEST_STEP)
        now = np.sign(w) * np.maximum(0, np.abs(w) - np.minimum(penalty / many, LARGEST_STEP))
        bias = self.bias + np.clip(sums[1] / (sums[2] + 1), -LARGEST_STEP, LARGEST_STEP)
        pace = len(self.losses) / (len(self.losses) + 3)
        weights, ahead = now + pace * (now - self.before), float(bias + pace * (bias - self.bias_before))
        factors = self.factors
        if pairs and rank:
            factors = factors.copy()
            for f in range(rank):
                g, curve, many = table[1 + f]
                sure = np.sign(g) * np.maximum(0, np.abs(g) - SURE * np.sqrt(curve))
                factors[:, f] = np.where(sure != 0, factors[:, f] + np.clip(3 * sure / (many + 1), -LARGEST_STEP, LARGEST_STEP), factors[:, f] * FADE)
        return Machine(self.hashes, self.spread, ahead, weights, factors, now, float(bias), [*self.losses, float(sums[0])], self.names)

    def finished(self) -> "Machine":
        """Without momentum, without factors that only faded, and without terms that weigh nothing."""
        telling = np.linalg.norm(self.factors, axis=1) >= START if self.factors.shape[1] else np.zeros(len(self.hashes), bool)
        kept = telling | (self.before != 0)
        factors = np.where(telling[:, None], self.factors, 0.0)[kept]
        return Machine(self.hashes[kept], self.spread[kept], self.bias_before, self.before[kept], factors, self.before[kept], self.bias_before, self.losses, self.names[kept] if len(self.names) else self.names)

    def scores(self, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The scores of texts, given by their terms' numbers."""
        return logistic(self.logits(at, ends)[0])


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, most_labelled: int) -> DataFrame:
    """(text, toxic, shard) of the documents that are learned from."""
    usable = labels.where("doc_id is not null and toxic is not null").where(~held_out())
    one = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    n = usable.count()
    if n > most_labelled:
        one = one.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * most_labelled / n))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.join(F.broadcast(one), "doc_id").select("text", "toxic", F.xxhash64("doc_id").alias("shard"))  # at most about most_labelled rows of two numbers


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) to how many documents, and toxic ones, have each term; flushed when large."""
    held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

    def out() -> Iterator[pa.RecordBatch]:
        words, sizes, toxic = pa.concat_arrays([w for w, _, _ in held]), *(np.concatenate([h[k] for h in held]) for k in (1, 2))
        for names, text, term in terms_in(words, sizes):
            n, k = np.bincount(term, minlength=len(names)), np.bincount(term, toxic[text], len(names)).astype(np.int64)
            whole = pa.RecordBatch.from_arrays([names.cast(pa.string()), pa.array(n, pa.int64()), pa.array(k, pa.int64())], ["name", "n", "k"])
            yield from (whole.slice(at, _ROWS) for at in range(0, len(names), _ROWS))

    for batch in common.slices(batches):
        held.append((*words_in(batch.column(0).to_pylist()), batch.column(1).to_numpy()))
        if sum(len(w) for w, _, _ in held) > _AT_ONCE:
            yield from out()
            held = []
    if held:
        yield from out()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """With each term's hash."""
    for batch in batches:
        yield batch.append_column("term", pa.array([_hash(name[0], name[1:]) for name in batch.column(0).to_pylist()], pa.int64()))


def fit(docs: DataFrame, labels: DataFrame, terms: int = 4_096, rank: int = 8, rounds: int = 30, few: int = 3, far: float = FAR, most_labelled: int = 100_000, shards: int = 8, seed: int = 7) -> Machine | float:
    """The machine that ``labels`` (doc_id, toxic) teach about ``docs`` (doc_id, text), or the one score of all texts, where labels are all alike or none."""
    spark = docs.sparkSession
    marked = labelled(docs, labels, most_labelled)
    n, toxic = marked.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < toxic < n:
        return float(bool(toxic))
    counts = common.map_arrow(marked.select("text", "toxic"), _counts, "name string, n long, k long").groupBy("name").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    part = toxic / n
    off = (F.abs(F.col("k") - F.col("n") * part) - 1) / F.sqrt(F.col("n") * part * (1 - part) + 1)
    telling = common.map_arrow(counts.where(F.col("n") >= few).withColumn("off", off).where(F.col("off") >= far), _hashed, "name string, n long, k long, off double, term long")
    chosen = telling.orderBy(F.desc("off"), "term").limit(terms).toArrow()  # the model's terms
    machine = Machine.start(chosen.column("term").to_numpy(), chosen.column("n").to_numpy(), toxic, n, rank, seed)
    machine.names = np.array(chosen.column("name").to_pylist(), object)
    names = pa.array(machine.names, pa.large_string())

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            at, ends = numbers_in(*words_in(batch.column(0).to_pylist()), names)
            at = at.astype("<i4")
            own = [at[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), batch.column(1), batch.column(2)], ["own", "toxic", "shard"])

    numbered = common.map_arrow(marked, number, "own binary, toxic long, shard long").repartition(shards, "shard").sortWithinPartitions("shard", "own", "toxic")
    numbered = common.materialise(spark, numbered, "toxic-terms")

    for step in range(rounds):

        def gradient(batches: Iterator[pa.RecordBatch], machine: Machine = machine) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            total = None
            for batch in batches:
                if batch.num_rows:
                    own = batch.column(0).to_pylist()
                    ends = np.r_[0, np.cumsum([len(x) // 4 for x in own])]
                    more = machine.gradient(np.frombuffer(b"".join(own), "<i4"), ends, np.asarray(batch.column(1), np.float64))
                    total = more if total is None else total + more
            if total is not None:
                yield pa.RecordBatch.from_pydict({"task": pa.array([TaskContext.get().partitionId()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

        told = common.map_arrow(numbered.select("own", "toxic"), gradient, "task int, sums binary").collect()  # a row a task, of which there are at most ``shards``
        sums = [np.frombuffer(r.sums) for r in sorted(told, key=lambda r: r.task)]  # always added in the same order
        machine = machine.moved(np.sum(sums, axis=0), step >= rounds // 3)
    common.discard(spark, numbered)
    return machine.finished()


def score(docs: DataFrame, machine: Machine | float) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted."""
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    if isinstance(machine, float):
        return slim.select("doc_id", "held_out", F.lit(machine).alias("score"), F.lit(int(machine)).alias("predicted"))
    shared = spark.sparkContext.broadcast(machine)  # as many terms as the model may have, at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        names = pa.array(own.names, pa.large_string())
        for batch in common.slices(batches):
            scores = np.round(own.scores(*numbers_in(*words_in(batch.column(2).to_pylist()), names)), 6)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return common.map_arrow(slim, run, "doc_id long, held_out boolean, score double, predicted int")


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all ``documents``, learned from ``labels``; null, empty, tied, repeated and missing rows as the module states."""
    docs = common.table(spark, sf_dir, "documents")
    return score(docs, fit(docs, common.table(spark, sf_dir, "labels")))
