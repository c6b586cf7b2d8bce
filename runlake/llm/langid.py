"""Language identification by words first, backing off to shorter and shorter character n-grams.

A known word has a log frequency in each language (add-half smoothing over the model's vocabulary).
An unseen word is read character by character: at each position the longest known n-gram of
``LONGEST`` = 4 letters or fewer (with ``^`` and ``$`` for the word's ends) gives its log frequency,
discounted by ``BACKOFF`` for each letter it is shorter; the word's score is their mean. A text's score for a
language is the sum over its words; the prediction is the largest (ties: the smallest name), its score
the softmax share. Words are runs of letters (Unicode categories L), so numerals and marks are none.

The model is fitted on a bounded sample: ``docs_per_lang`` documents of each language, by a hash of
doc_id, and fewer where there are so many languages that it would be over ``most_docs`` in all. Units are counted in Spark;
if they and their frequencies would take over ``most_bytes``, the documents of a language are halved and counted again, down
to one, so the driver gets more only where one document a language has more; the smaller sample is part of the larger. Every word and n-gram of
the sample is in the model, which is arrays only. Prediction reads whole texts of all documents, and nothing but the text: the words of a batch
are numbered, the new ones among them scored together, and a text's score is a sum over its numbers.

N-grams form a trie: the key of a longer one is its beginning's place and its last letter, so those
of each size are one sorted array, which a batch of words searches at once.

Defined cases: null text or text without a letter is ``und`` with score 0, and so is everything when
there is nothing to learn from; null lang is never learned from; documents with null doc_id are never
learned from and count as held out; repeated rows are predicted each for itself; an empty table gives
no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlake.llm import common

LONGEST, BACKOFF = 4, 0.7
ROW_BYTES = 64  #: what a unit's row takes while the model is built, its name and frequencies aside
PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double"


_RUNS = re.compile(r"[^\W\d_]+")  # letters and numerals that aren't decimal


def _letters(run: str) -> list[str]:
    """The runs of letters within a run that may hold numerals."""
    return [run] if run.isalpha() else "".join(c if c.isalpha() else " " for c in run).split()


def words_of(text: str | None) -> list[str]:
    runs = _RUNS.findall(text.lower()) if text else []
    return runs if not runs or "".join(runs).isalpha() else [w for run in runs for w in _letters(run)]


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to the counts of words (size 0) and n-grams (size 1 to LONGEST) of a partition; flushed when large."""
    seen: Counter = Counter()

    def out() -> pa.RecordBatch:
        rows = list(seen.items())
        return pa.RecordBatch.from_pydict({"lang": [k[0] for k, _ in rows], "size": pa.array([k[1] for k, _ in rows], pa.int32()), "unit": [k[2] for k, _ in rows], "n": pa.array([n for _, n in rows], pa.int64())}, schema=pa.schema([("lang", pa.string()), ("size", pa.int32()), ("unit", pa.string()), ("n", pa.int64())]))

    for batch in common.slices(batches):
        words: Counter = Counter()
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words.update((lang, w) for w in words_of(text))
        for (lang, word), n in words.items():
            seen[lang, 0, word] += n
            around = f"^{word}$"
            for size in range(1, LONGEST + 1):
                for k in range(len(around) - size + 1):
                    seen[lang, size, around[k : k + size]] += n
        if len(seen) > 400_000:
            yield out()
            seen.clear()
    yield out()


def _hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))


def _column(values: pa.ChunkedArray | list) -> pa.Array:
    return values.combine_chunks() if isinstance(values, pa.ChunkedArray) else pa.array(values)


class Model:
    """Log frequencies by language of words (by their hashes in order, with the words to tell equal hashes apart) and of n-grams (a trie: keys and frequencies of each size)."""

    def __init__(self, langs: list[str], hashes: np.ndarray, words: pa.Array, table: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        self.langs, self.hashes, self.words, self.table, self.levels = langs, hashes, words, table, levels

    @classmethod
    def of(cls, lang: pa.ChunkedArray | list, size: pa.ChunkedArray | list, unit: pa.ChunkedArray | list, n: pa.ChunkedArray | list) -> "Model":
        """From the units' counts, column by column; a unit has a row for each language that has it."""
        names, units = _column(lang).cast(pa.string()).dictionary_encode(), _column(unit).cast(pa.string())
        langs = sorted(names.dictionary.to_pylist())
        column = np.array([langs.index(name) for name in names.dictionary.to_pylist()], np.int64)[names.indices.to_numpy()]
        sizes, counted = (_column(c).cast(pa.int64()).to_numpy() for c in (size, n))

        def log_frequencies(rows: int, row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            counts = np.zeros((rows, len(langs)))
            np.add.at(counts, (row, column[at]), counted[at])
            own = counts.any(axis=1)
            return own, np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * max(1, own.sum())))

        at = np.flatnonzero(sizes == 0)
        words = units.take(pa.array(at)).dictionary_encode()
        hashes = np.fromiter((_hash(w.as_py()) for w in words.dictionary), np.uint64, len(words.dictionary))
        order = np.argsort(hashes)
        table = log_frequencies(len(hashes), words.indices.to_numpy(), at)[1]
        levels, at = [], np.flatnonzero(sizes > 0)
        place = np.zeros(len(at), np.int64)
        for s in range(1, LONGEST + 1):
            longer = sizes[at] >= s
            at, place = at[longer], place[longer]
            letters = pc.utf8_slice_codeunits(units.take(pa.array(at)), s - 1, s).dictionary_encode()
            codes = np.array([ord(c) for c in letters.dictionary.to_pylist()], np.int64)[letters.indices.to_numpy()]
            keys, place = np.unique(place << 21 | codes, return_inverse=True)
            ends = sizes[at] == s
            levels.append((keys, *log_frequencies(len(keys), place[ends], at[ends])))
        return cls(langs, hashes[order], words.dictionary.take(pa.array(order)), table[order], levels)

    def rows_of(self, words: list[str]) -> np.ndarray:
        """Each word's row in the table, -1 where it has none."""
        hashes = np.fromiter(map(_hash, words), np.uint64, len(words))
        row, at, told = np.full(len(words), -1, np.int64), np.searchsorted(self.hashes, hashes), pa.array(words, pa.string())
        left = np.arange(len(words))
        while True:
            left = left[at[left] < len(self.hashes)]
            left = left[self.hashes[at[left]] == hashes[left]]
            if not len(left):
                return row
            same = pc.equal(self.words.take(pa.array(at[left])), told.take(pa.array(left))).to_numpy(zero_copy_only=False)
            row[left[same]] = at[left[same]]
            left = left[~same]
            at[left] += 1

    def unseen(self, words: list[str]) -> np.ndarray:
        """Scores of words by their n-grams alone."""
        codes = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        sizes = np.array([len(w) + 2 for w in words], np.int64)
        word, ends = np.repeat(np.arange(len(words)), sizes), np.cumsum(sizes)
        total, used = np.zeros((len(words), len(self.langs))), np.zeros(len(words))
        here, place = np.arange(len(codes)), np.zeros(len(codes), np.int64)
        longest, found = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
        for s, (keys, own, _) in enumerate(self.levels, 1):
            inside = here + s <= ends[word[here]]
            here, place = here[inside], place[inside]
            if not len(keys) or not len(here):
                break
            key = place << 21 | codes[here + s - 1]
            place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[place] == key
            here, place = here[hit], place[hit]
            sound = own[place]
            longest[here[sound]], found[here[sound]] = s, place[sound]
        for s, (_, _, frequencies) in enumerate(self.levels, 1):
            at = np.flatnonzero(longest == s)
            for k in range(len(self.langs)):
                total[:, k] += np.bincount(word[at], frequencies[found[at], k], minlength=len(words)) * BACKOFF ** (LONGEST - s)
            used += np.bincount(word[at], minlength=len(words))
        return total / np.maximum(1, used)[:, None]

    def score(self, words: list[str]) -> np.ndarray:
        """A row of scores for each word."""
        row = self.rows_of(words)
        out = np.zeros((len(words), len(self.langs)))
        out[row >= 0] = self.table[row[row >= 0]]
        new = np.flatnonzero(row < 0)
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            out[part] = self.unseen([words[k] for k in part.tolist()])
        return out


class Rows(dict):
    """Word to its row in a score table, which starts afresh when it has over ``most`` rows."""

    def __init__(self, model: Model, most: int = 150_000) -> None:
        super().__init__()
        self.model, self.most, self.new = model, most, []
        self.table = np.zeros((0, len(model.langs)))

    def __missing__(self, word: str) -> int:
        self[word] = row = len(self)
        self.new.append(word)
        return row

    def sums(self, texts: list[list[str]]) -> np.ndarray:
        """Summed scores of each text's words, in portions of the words."""
        out = np.zeros((len(texts), len(self.model.langs)))
        sizes = np.array([len(t) for t in texts], np.int64)
        text, words = np.repeat(np.arange(len(texts)), sizes), [w for t in texts for w in t]
        for at in range(0, len(words), self.most):
            if len(self) > self.most:
                self.clear()
                self.table = self.table[:0]
            rows = np.array(list(map(self.__getitem__, words[at : at + self.most])), np.int64)
            if self.new:
                self.table = np.concatenate([self.table, self.model.score(self.new)])
                self.new = []
            for k in range(out.shape[1]):
                out[:, k] += np.bincount(text[at : at + self.most], self.table[rows, k], minlength=len(texts))
        return out


def fit(docs: DataFrame, docs_per_lang: int = 2_000, most_docs: int = 100_000, most_bytes: int = 128 << 20) -> Model:
    """From (doc_id, text, lang), all of which may be learned from."""
    spark = docs.sparkSession
    usable = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    sizes = usable.groupBy("lang").count().collect()  # one short row a language
    each = min(docs_per_lang, max(1, most_docs // max(1, len(sizes))))
    while True:
        shares = spark.createDataFrame([(r.lang, int((1 << 30) * min(1.0, each / r["count"]))) for r in sizes], "_lang string, _share long")
        sample = usable.join(F.broadcast(shares), F.col("lang") == F.col("_lang")).where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("_share")).select("lang", "text")
        counts = common.map_arrow(sample, _units, "lang string, size int, unit string, n long").groupBy("lang", "size", "unit").agg(F.sum("n").alias("n"))
        held = common.materialise(spark, counts, "language-units")
        rows, letters = held.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("unit")), F.lit(0))).first()
        if each == 1 or rows * (ROW_BYTES + 8 * len(sizes)) + letters <= most_bytes:
            break
        common.discard(spark, held)
        each //= 2
    units = held.toArrow()  # of at most most_bytes
    common.discard(spark, held)
    return Model.of(*(units.column(c) for c in ("lang", "size", "unit", "n")))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of ``docs`` (doc_id, held_out, text): doc_id, held_out, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of at most fit's most_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        rows = Rows(own)
        for batch in common.slices(batches):
            texts = [words_of(t) for t in batch.column(2).to_pylist()]
            if own.langs:
                sums = rows.sums(texts)
                best = sums.argmax(axis=1)
                share = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
            names = [own.langs[best[k]] if own.langs and w else "und" for k, w in enumerate(texts)]
            scores = [float(share[k]) if own.langs and w else 0.0 for k, w in enumerate(texts)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "held_out": batch.column(1), "lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64())})

    return common.map_arrow(docs.select(F.col("doc_id").cast("long"), "held_out", "text"), run, PREDICTED)


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all ``documents``: doc_id, held_out, lang_pred, score; null, letterless, repeated and missing rows as the module states."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))
    marked = docs.withColumn("held_out", held_out)
    return predict(marked, fit(marked.where("not held_out")))
