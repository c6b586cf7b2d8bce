"""Importance resampling and language identification: planted cases, held-out accuracy, edge tables."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from brute import edge_texts

from runlake.llm import importance, langid

COMMON = ["the", "of", "and", "to", "in", "is", "it", "on"]


def prose(rng, n=60):
    return " ".join(rng.choice(COMMON) if rng.random() < 0.5 else "".join(rng.choice(["ta", "re", "mo", "li", "sun"]) for _ in range(3)) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(9)
    good = [(k, prose(rng)) for k in range(400)]
    toxic = [(1000 + k, prose(rng) + " vile scum " + prose(rng) + " wretch") for k in range(60)]
    junk = [(2000 + k, " ".join([rng.choice(["buy", "now", "xx"])] * 80)) for k in range(40)]
    labels = [(i, 1, 0) for i, _ in good if i % 2] + [(i, 1, 1) for i, _ in toxic if i % 2] + [(i, 0, 0) for i, _ in junk if i % 2]
    return good, toxic, junk, labels


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_bad_documents_go_and_good_ones_stay(spark, docs, corpus):
    good, toxic, junk, labels = corpus
    frame, marks = docs(good + toxic + junk), labels_of(spark, labels + [(1, 1, 0), (99_999, 0, 1)])
    told = {r.doc_id: r for r in importance.select(frame, marks).collect()}
    assert len(told) == 500
    kept = {i for i, r in told.items() if r.kept}
    assert len([i for i, _ in good if i not in kept]) <= 20
    assert len([i for i, _ in toxic + junk if i in kept]) <= 5
    out = importance.keep(frame, marks)
    assert out.columns == frame.columns and {r.doc_id for r in out.collect()} == kept
    again = {r.doc_id for r in importance.keep(frame.repartition(3), marks).collect()}
    assert again == kept


def test_without_labels_everything_stays(spark, docs):
    rows = edge_texts()
    for marks in ([], [(500, 1, 0)], [(0, None, None)], [(3, 1, 0), (3, 1, 1)]):
        told = importance.select(docs(rows), labels_of(spark, marks)).collect()
        assert len(told) == len(rows) and all(r.kept for r in told)
        assert [r.log_weight for r in told if r.doc_id in (0, 1, 2)] == [0, 0, 0]
    assert importance.keep(docs([]), labels_of(spark, [(1, 1, 0)])).count() == 0


def test_deviations_follow_the_counts():
    r = importance.deviation(np.array([1000, 1000, 3, 0, 200]), np.array([500, 0, 0, 0, 10]), 2000, 1000)
    assert r[0] == 0 and r[1] < -2 and r[2] == r[3] == 0
    assert abs(r[4] - (np.log(10.5 / 100.5) + 3 / np.sqrt(100.5) + 0.6)) < 1e-9


def test_weights_against_a_plain_version(spark, docs, corpus):
    """The model and the weights from dictionaries of n-gram sets, without Spark or batches."""
    good, toxic, junk, labels = corpus
    rows, buckets, known = good + toxic + junk, importance.Buckets(importance.sizes_for(10)), importance.Words()
    sets = {i: set(importance.features([t], known, buckets)[1].tolist()) for i, t in rows}
    mine = {i for i, q, t in labels if q == 1 and t == 0}
    weight = dict.fromkeys(sets, 0.0)
    for b in set().union(*sets.values()):
        holders = [i for i in sets if b in sets[i]]
        expected, seen = len(holders) * len(mine) / len(rows), len(mine.intersection(holders))
        ratio = np.log((seen + 0.5) / (expected + 0.5))
        for i in holders:
            weight[i] += np.sign(ratio) * max(0, abs(ratio) - importance.SHRINK / np.sqrt(expected + 0.5) - importance.MARGIN)
    told = importance.select(docs(rows), labels_of(spark, labels), seed=5).collect()
    assert all(abs(r.log_weight - weight[r.doc_id]) < 1e-5 for r in told)
    k = round(len(rows) * len(mine) / len(labels))
    assert sum(r.kept for r in told) == k and {r.doc_id for r in told if r.kept} == {r.doc_id for r in sorted(told, key=lambda r: -r.key)[:k]}


def test_inclusion_frequencies_are_those_of_gumbel_top_k(spark):
    """Over 200 seeds, rows are drawn as often as by sampling without replacement in proportion to the weights."""
    from pyspark.sql import functions as F

    weights, k, seeds = np.linspace(-3, 3, 40), 25, range(200)
    frame = spark.createDataFrame([(i, float(w)) for i, w in enumerate(weights)], "doc_id long, log_weight double").coalesce(1)
    keys = np.array([list(r) for r in frame.select(*[(F.col("log_weight") + importance.noise(s)).alias(f"k{s}") for s in seeds]).collect()])
    drawn = (keys >= np.sort(keys, axis=0)[-k]).mean(axis=1)
    rng, times = np.random.default_rng(2), np.zeros(40)
    for _ in range(4_000):
        times[rng.choice(40, k, replace=False, p=np.exp(weights) / np.exp(weights).sum())] += 1
    assert np.abs(drawn - times / 4_000).max() < 0.13 and np.abs(drawn - times / 4_000).mean() < 0.03
    for s in (3, 4):
        key = F.col("log_weight") + importance.noise(s)
        limit = importance.limit_of(frame, key, k / 40)
        assert {r.doc_id for r in frame.where(key >= limit).collect()} == set(np.flatnonzero(keys[:, s] >= np.sort(keys[:, s])[-k]).tolist())


def test_a_stated_share_is_kept(spark, docs, corpus):
    good, toxic, junk, labels = corpus
    told = importance.select(docs(good + toxic + junk), labels_of(spark, labels), share=0.3).collect()
    assert sum(r.kept for r in told) == 150
    other = importance.select(docs(good + toxic + junk), labels_of(spark, labels), share=0.3, seed=18).collect()
    assert {r.doc_id for r in other if r.kept} != {r.doc_id for r in told if r.kept}


def test_clashing_columns_keep_their_values(spark, docs, corpus):
    from pyspark.sql import functions as F

    good, toxic, junk, labels = corpus
    frame = docs(good + toxic + junk).select("*", F.col("doc_id").alias("log_weight"), F.lit("x").alias("N_WORDS"), F.lit(3).alias("good"), (F.col("doc_id") * 2).alias("label_id"), F.lit(1.5).alias("key"))
    out = importance.keep(frame.withColumn("doc_id", F.col("doc_id").cast("int")), labels_of(spark, labels))
    want = importance.keep(docs(good + toxic + junk), labels_of(spark, labels))
    assert out.columns == frame.columns and out.schema["doc_id"].dataType.simpleString() == "int"
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in want.collect()}
    assert all((r.log_weight, r.N_WORDS, r.good, r.label_id, r.key, r.row_id) == (r.doc_id, "x", 3, 2 * r.doc_id, 1.5, "clash") for r in out.collect())


def test_buckets_grow_with_the_corpus():
    assert [importance.sizes_for(n)[0] for n in (0, 10**7, 2 * 10**8, 10**9, 5 * 10**10, 10**14)] == [1 << 18, 1 << 18, 1 << 18, 1 << 19, 1 << 22, 1 << 22]


def test_features_by_hand():
    known = importance.Words(most=12)  # starts afresh again and again

    def of(*texts):
        text, bucket, sizes = importance.features(list(texts), known, importance.Buckets(importance.sizes_for(0)))
        assert sizes.tolist() == [len((t or "").split()) for t in texts]
        return [sorted(bucket[text == k].tolist()) for k in range(len(texts))]

    texts = [None, "", " \n", "word", "a b", "a b a b", "no no", "no no no", "no " * 9, "Big WORD x1!! " * 30, "b a"]
    each = of(*texts)
    assert each[:3] == [[], [], []] and len(each[3]) == 3
    assert set(each[4]) <= set(each[5]) and all(len(e) == len(set(e)) for e in each)
    assert len(each[7]) == len(each[6]) + 1 and len(each[8]) == len(each[6]) + 3
    assert [of(t)[0] for t in texts] == each  # a text's features don't depend on its neighbours
    assert each[4] != each[10]
    assert [importance._shape(w) for w in ("a", "Ab", "ÀB", "été...", "x1!!!", "1-2", "**a**")] == ["a", "Aa", "AA", "a..", "a0!!", "0-0", "**a**"]


def test_kth_largest_with_ties(spark):
    rng = random.Random(10)
    values = [rng.choice([0.0, 1.0, rng.random() * 5, -7.5]) for _ in range(500)]
    frame = spark.createDataFrame([(v,) for v in values], "key double")
    for k in (1, 2, 100, 250, 499, 500, 900):
        want = sorted(values, reverse=True)[min(k, 500) - 1]
        assert importance.kth_largest(frame, k, few=5, bins=4) == want


def test_gumbel_noise_is_gumbel(spark):
    x = np.array([r[0] for r in spark.range(20_000).withColumnRenamed("id", "doc_id").select(importance.noise(17)).collect()])
    assert abs(x.mean() - 0.5772) < 0.03 and abs(x.var() - np.pi**2 / 6) < 0.06


LANGS = {"aa": ["ka", "lo", "mi", "zu"], "bb": ["the", "str", "ing", "ow"], "cc": ["é", "ça", "où", "eau"]}


def tongue(rng, lang, n):
    return " ".join("".join(rng.choice(LANGS[lang]) for _ in range(rng.randrange(1, 5))) for _ in range(n))


def test_language_of_held_out_documents(spark, docs):
    rng = random.Random(11)
    rows, langs = [], []
    for k in range(300):
        lang = rng.choice(sorted(LANGS))
        rows.append((k, tongue(rng, lang, rng.choice([1, 3, 30]))))
        langs.append(lang)
    frame = docs(rows, langs)
    frame.createOrReplaceTempView("language_documents")
    from pyspark.sql import functions as F

    marked = frame.withColumn("held_out", F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    model = langid.fit(marked.where("not held_out").select("doc_id", "text", "lang"))
    told = {r.doc_id: r for r in langid.predict(marked, model).collect()}
    held = [k for k in range(300) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert [k for k in range(300) if told[k].held_out] == held
    assert sum(told[k].lang_pred == langs[k] for k in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in told.values())
    blind = langid.predict(marked.drop("lang", "source"), model).collect()
    assert {r.doc_id: r.lang_pred for r in blind} == {k: r.lang_pred for k, r in told.items()}


def plain_score(counts, word):
    """A word's log frequencies by dictionaries, one n-gram after the other."""
    langs = sorted({c[0] for c in counts})
    tables = [{} for _ in range(5)]
    for lang, size, unit, n in counts:
        tables[size].setdefault(unit, np.zeros(len(langs)))[langs.index(lang)] += n
    logs = [{u: np.log((c + 0.5) / (sum(own.values()) + 0.5 * len(own))) for u, c in own.items()} for own in tables]
    if word in logs[0]:
        return logs[0][word]
    around, total, used = f"^{word}$", np.zeros(len(langs)), 0
    for k in range(len(around)):
        for size in (4, 3, 2, 1):
            if k + size <= len(around) and around[k : k + size] in logs[size]:
                total, used = total + logs[size][around[k : k + size]] * 0.7 ** (4 - size), used + 1
                break
    return total / max(1, used)


def model_of(counts):
    return langid.Model.of(*map(list, zip(*counts, strict=True)))


def test_words_back_off_to_shorter_grams():
    counts = [("aa", 0, "kalo", 9), ("bb", 0, "string", 9), ("aa", 2, "ka", 9), ("bb", 2, "xy", 9), ("aa", 4, "^zuz", 9), ("bb", 4, "^str", 9), ("aa", 1, "z", 5), ("bb", 1, "w", 5)]
    model = model_of(counts)
    words = ["kalo", "string", "kax", "strop", "zzz", "www", "???", "a", "zuz", "𝄞w"]
    scores = model.score(words)
    assert scores.argmax(axis=1).tolist()[:6] == [0, 1, 0, 1, 0, 1]
    assert all(np.allclose(s, plain_score(counts, w)) for s, w in zip(scores, words, strict=True)) and not scores[6].any()
    rows = langid.Rows(model, most=1_000)
    for _ in range(2):
        assert np.allclose(rows.sums([["kalo", "kax"], [], ["www"] * 3_000]), [scores[0] + scores[2], [0, 0], 3_000 * scores[5]])


def test_every_word_scores_as_in_a_plain_version(spark):
    rng = random.Random(30)
    texts = [(rng.choice("xyz"), " ".join("".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 7))) for _ in range(40))) for _ in range(60)]
    frame = spark.createDataFrame([(k, t, lang) for k, (lang, t) in enumerate(texts)], "doc_id long, text string, lang string")
    model, counts = langid.fit(frame), {}
    for lang, text in texts:
        for w in text.split():
            counts[lang, 0, w] = counts.get((lang, 0, w), 0) + 1
            for s in range(1, 5):
                for k in range(len(w) + 3 - s):
                    counts[lang, s, f"^{w}$"[k : k + s]] = counts.get((lang, s, f"^{w}$"[k : k + s]), 0) + 1
    flat = [(*key, n) for key, n in counts.items()]
    words = [texts[0][1].split()[0], *("".join(rng.choice("abcdéf") for _ in range(rng.randrange(1, 9))) for _ in range(80))]
    assert model.langs == ["x", "y", "z"]
    assert all(np.allclose(s, plain_score(flat, w)) for s, w in zip(model.score(words), words, strict=True))


def test_words_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(langid, "_hash", lambda w: len(w))
    counts = [(lang, 0, w, n) for n, (lang, w) in enumerate([("aa", "ab"), ("bb", "cd"), ("aa", "ef"), ("bb", "ef"), ("aa", "long"), ("bb", "lung")], 1)]
    model = model_of(counts)
    words = ["ef", "cd", "lung", "ab", "no", "long", "ling", "x", "longer", "cd"]
    assert all(np.allclose(s, plain_score(counts, w)) for s, w in zip(model.score(words), words, strict=True))
    assert model.rows_of([]).tolist() == [] and model_of([counts[0]]).rows_of(["ab", "zz"]).tolist() == [0, -1]


def test_model_stays_within_its_bytes(spark):
    rng = random.Random(31)
    texts = [(k, " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(30)), "xy"[k % 2]) for k in range(200)]
    frame = spark.createDataFrame([*texts, (200, None, "x"), (201, "qq", None)], "doc_id long, text string, lang string")
    whole, small, one = langid.fit(frame), langid.fit(frame, most_bytes=400_000), langid.fit(frame, most_bytes=1)

    def size(model):
        return model.table.nbytes + model.hashes.nbytes + model.words.nbytes + sum(a.nbytes for level in model.levels for a in level)

    assert size(small) <= 400_000 < size(whole) and len(one.words) < len(small.words) < len(whole.words)
    assert set(one.words.to_pylist()) <= set(small.words.to_pylist()) <= set(whole.words.to_pylist()) == {w for _, t, _ in texts for w in t.split()}


def test_letters_are_of_category_l():
    assert langid.words_of("Ab½c ²x Ⅷ ④ e\u0301 ᵃ 東京_7ß") == ["ab", "c", "x", "e", "ᵃ", "東京", "ß"]
    assert not any(map(langid.words_of, ["½ ² Ⅷ", "④", "12 _ ٣", "\u0301", "", None]))


def test_language_edges(spark, docs):
    from pyspark.sql import functions as F

    rows = edge_texts()
    marked = docs(rows, ["xx", None, "xx", "xx", *["yy"] * 12]).withColumn("held_out", F.lit(False))
    model = langid.fit(marked)
    told = langid.predict(marked, model).collect()
    assert len(told) == len(rows)
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in told if r.doc_id in (0, 1, 2, 11))
    assert all(r.lang_pred in ("xx", "yy") for r in told if r.doc_id in (3, 7, 8, 9))
    numerals = docs([(1, "½ ² Ⅷ ④"), (2, "\u0301 12"), (3, "½a")]).withColumn("held_out", F.lit(True)).withColumn("lang_pred", F.lit("zz"))
    assert [(r.lang_pred == "und", r.score == 0) for r in langid.predict(numerals, model).orderBy("doc_id").collect()] == [(True, True), (True, True), (False, False)]
    none = langid.predict(marked, langid.fit(marked.where("false"))).collect()
    assert {r.lang_pred for r in none} == {"und"}
    assert langid.predict(marked.where("false"), model).count() == 0
