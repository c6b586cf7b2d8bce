from __future__ import annotations

import random

import brute
import numpy as np
import pytest
from brute import edge_texts

from runlake.llm import components, simhash_anchor


def test_every_half_is_covered_and_close_halves_meet():
    rng = random.Random(1)
    for _ in range(300):
        x = rng.getrandbits(64)
        row, key, home = simhash_anchor.anchors(np.array([x], "u8"))
        assert home.sum() == 2 and len(set(key.tolist())) == len(key)
        for k in key.tolist():
            half, at = k & 0xFFFFFFFF, k >> 32
            assert ((x >> 32 * at & 0xFFFFFFFF) ^ half).bit_count() <= 2
        y = x
        for b in rng.sample(range(64), rng.randrange(4)):
            y ^= 1 << b
        own = set(key[home].tolist())
        assert own & set(simhash_anchor.anchors(np.array([y], "u8"))[1].tolist())


def test_fingerprints_by_brute_force():
    rng = random.Random(2)
    texts = [t for _, t in edge_texts()] + [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(40))) for _ in range(100)]
    assert all(simhash_anchor.fingerprint(t) == brute.fingerprint(t) for t in texts if not t or len(t) < 5000)
    assert simhash_anchor.fingerprint(None) == simhash_anchor.fingerprint(" \t\r\n") == 0
    assert simhash_anchor.fingerprint("ÄB c d") != simhash_anchor.fingerprint("äb c d")
    assert simhash_anchor.fingerprint("A b") == simhash_anchor.fingerprint("a B")


@pytest.mark.parametrize("most", [20_000, 40])
def test_links_connect_what_brute_force_connects(spark, most):
    """Also with anchors that are too large for one group and go to the second round."""
    rng = random.Random(3)
    fps = set()
    for _ in range(60):
        x = rng.getrandbits(64)
        fps.add(x)
        for _ in range(rng.randrange(4)):
            for b in rng.sample(range(64), rng.randrange(1, 5)):
                x ^= 1 << b
            fps.add(x)
    centre = rng.getrandbits(64)
    fps |= {centre ^ 1 << a ^ 1 << b for a in range(20) for b in range(20)}
    fps = sorted(fps)
    want = brute.groups(fps)
    signed = np.array(fps, "u8").view("i8").tolist()
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    roots = {r.node: r.root for r in components.components(components.thin(simhash_anchor.links(frame, most))).collect()}
    got = [roots.get(x, x) for x in signed]
    assert {(a, b) for a, b in zip(want, got, strict=True)} == {(a, got[a]) for a in set(want)}
    assert len(set(got)) == len(set(want))


def test_components_on_chains_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edge_documents(spark, docs):
    rows = edge_texts()
    got = simhash_anchor.near_duplicates(docs(rows)).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert [by_id[i].component_id for i in (0, 1, 2)] == [0, 0, 0]
    assert by_id[5].component_id == by_id[6].component_id == 5
    assert by_id[None].component_id is None
    assert [r.component_id for r in got if r.doc_id == 12] == [12, 12]
    assert simhash_anchor.near_duplicates(docs([])).count() == 0


def test_one_of_each(spark, docs):
    rows = [*edge_texts(), (90, "no id at all"), (91, "NO ID at all")]
    kept = simhash_anchor.one_of_each(docs(rows))
    assert kept.columns == docs(rows).columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert ids == sorted([0, 3, 4, 5, 7, 8, 9, 10, 11, 12, 13, 90], key=str)
    assert simhash_anchor.one_of_each(docs([])).count() == 0


@pytest.mark.parametrize("most", [500_000, 0])
def test_one_of_each_keeps_values_and_tells_null_from_empty(spark, docs, most):
    """By broadcast and by shuffle; rows repeated in full, rows that differ in another column only, and columns named as the operator's own."""
    from pyspark.sql import functions as F

    rows = [(1, "one two three four"), (1, "one two three four"), (1, None), (1, ""), (2, "five six seven eight nine"), (2, "five six seven eight nine"), (None, "ten"), (None, "ten")]
    frame = docs(rows).select("*", F.lit(5).alias("row"), F.lit("i").alias("ID"), F.lit(2.5).alias("_row"), F.lit(1).alias("n"), F.create_map(F.lit("a"), F.lit(1)).alias("m"))
    out = simhash_anchor.one_of_each(frame, most)
    assert out.columns == frame.columns
    got = out.collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == [(0, "ten"), (1, ""), (1, "one two three four"), (2, "five six seven eight nine")]
    assert all((r.row, r.ID, r._row, r.n, r.row_id, r.fp, r.m) == (5, "i", 2.5, 1, "clash", 7, {"a": 1}) for r in got)
    half = frame.withColumn("source", F.when(F.monotonically_increasing_id() % 2 == 0, "x").otherwise("y"))
    assert len(simhash_anchor.one_of_each(half, most).collect()) == 4


def test_skewed_join_joins_everything(spark):
    from runlake.llm import common

    keys = [1] * 900 + list(range(2, 60))
    many = spark.createDataFrame([(k, n) for n, k in enumerate(keys)], "k long, n long")
    one = spark.createDataFrame([(k, keys.count(k), f"v{k}") for k in [*set(keys), 77]], "k long, rows long, v string")
    got = common.join_skewed(many, one, "k", "rows", parts=100)
    assert sorted((r.k, r.n, r.v) for r in got.collect()) == sorted((k, n, f"v{k}") for n, k in enumerate(keys))
