"""Token store and packing: ids as the library gives them, exact round trips, whole coverage."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from brute import edge_texts
from hypothesis import given, settings
from hypothesis import strategies as st

from runlake.llm import packing, token_store
from runlake.llm.tokens import encoder, ids_of

public = pytest.importorskip("public_tokenizers")
NAMES = ("byte_bpe_50k.json", "word_bpe_49k.json")


def plain(name, text):
    return encoder(name).tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", NAMES)
def test_cached_ids_equal_the_librarys(name):
    odd = [t for _, t in edge_texts()] + ["a  b", " lead", "trail ", "a\n\nb", "\nx", "x\n", "don't WE'LL 'tis", "123 4a5 _x_", "\x1cy \x1f z", "ΣΑΣ Σ", "é ok", "ﬁ K²³½", "A.B, c., d,. ,e ...", "x y　z", "zİ.", "\u0085 a"]
    odd += [p + chr(c) + s for c in range(1, 0x300) for p, s in (("", ""), ("a", "b,"), ("z ", " z"))]
    assert all(ids_of(encoder(name).encode(t)).tolist() == plain(name, t) for t in odd)


@pytest.mark.parametrize("name", NAMES)
@settings(max_examples=150, deadline=None)
@given(text=st.text(alphabet=st.one_of(st.sampled_from("ab Zé\n\t.,!'sİß1 _ ́"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_cached_ids_on_any_text(name, text):
    assert ids_of(encoder(name).encode(text)).tolist() == plain(name, text)


def test_cache_starts_afresh_when_full(monkeypatch):
    from runlake.llm import tokens

    monkeypatch.setattr(tokens, "CACHE_ENTRIES", 5)
    e = tokens.Encoder(NAMES[0])
    text = " ".join(f"word{chr(97 + k)} other" for k in range(20))
    assert ids_of(e.encode(text)).tolist() == plain(NAMES[0], text) and len(e) <= 7


@pytest.mark.parametrize("frame", [1 << 14, 7])
def test_store_round_trip(spark, docs, frame):
    rows = edge_texts()
    manifest = token_store.write_store(docs(rows), NAMES[0], 2, frame)
    got = sorted(token_store.read_store(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    ids = {i: [*plain(NAMES[0], t), 2] for i, t in rows}
    at = 0
    for r in got:
        own = ids[r.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        at += len(own)
    found = token_store.read_documents(manifest, [12, 7])
    assert [x.tolist() for x in found[12]] == [ids[12]] * 2 and found[7][0].tolist() == ids[7]
    assert token_store.read_documents(manifest, []) == {} and token_store.read_documents(manifest, [-77]) == {}


def test_ranges_are_even_whole_and_in_order(spark, docs):
    rows = [(i if i % 10 else None, "some words " * (i % 7)) for i in range(600)] + [(5, "one id, one text")] * 300 + [(6, f"one id, text {i}") for i in range(300)]
    keys = docs(rows).select("doc_id", token_store.F.xxhash64("text").alias("tie"), "text")
    begins = token_store.ranges(keys, 2_000)
    assert begins == sorted(set(begins)) and 10 <= len(begins) <= 40 and any(b[:2] == (True, 6) for b in begins)
    parts = token_store.encoded(docs(rows), NAMES[0], 2, 2_000).withColumn("part", token_store.F.spark_partition_id()).collect()
    assert len({r.part for r in parts}) > 10
    order = [(r.part, r.doc_id is not None, r.doc_id or 0) for r in parts]
    assert order == sorted(order) and [k[1:] for k in order] == sorted(k[1:] for k in order) and len(order) == len(rows)
    few = token_store.ranges(keys, 2_000, sample=100)
    assert 1 <= len(few) <= 15
    assert token_store.ranges(keys.limit(0), 2_000) == []
    files = token_store.write_store(docs(rows), NAMES[0], 2).collect()
    assert sum(f.n_docs for f in files) == len(rows) and sum(f.null_ids for f in files) == 60


def test_the_number_of_ranges_follows_the_bytes(spark):
    F, n = token_store.F, 200_000
    keys = spark.range(n).select(F.col("id").alias("doc_id"), F.xxhash64("id").alias("tie"), F.expr(f"repeat('x', if(id < {n // 10}, 3000, 300))").alias("text"))
    total, part = n // 10 * 3_000 + n * 9 // 10 * 300, 1 << 19
    begins = token_store.ranges(keys, part, sample=1_000)  # 50 ranges' worth; some 220 are needed, so more is drawn
    edges = [0, *(b[1] for b in begins), n]
    assert abs(len(begins) - total / part) < 20
    below = lambda x: min(x, n // 10) * 3_000 + max(0, x - n // 10) * 300
    assert max(below(b) - below(a) for a, b in zip(edges, edges[1:], strict=False)) < 3 * part
    assert len(token_store.ranges(keys, part, sample=1_000, most=1_200)) <= 60  # a documented bound of the sample


def test_only_the_frames_asked_for_are_read_and_damage_is_noticed(tmp_path):
    import pyarrow.fs as pafs

    with token_store.opened(f"file://{tmp_path}/a/x.tok.zst", write=True) as sink:
        w = token_store.StoreWriter(sink, 4, 100)
        docs = [np.arange(k, k + n, dtype="u4") for k, n in ((0, 30), (70_000, 250), (5, 0), (9, 20))]
        for k, d in enumerate(docs):
            w.add(k, d)
        w.close()
    path = tmp_path / "a" / "x.tok.zst"
    with pafs.LocalFileSystem().open_input_file(str(path)) as source:
        r = token_store.StoreReader(source)
        asked = []
        whole = r.frame
        r.frame = lambda k: asked.append(k) or whole(k)
        assert r.ids(3).tolist() == docs[3].tolist() and asked == [4]
        assert r.ids(1).tolist() == docs[1].tolist() and asked == [4, 1, 2, 3]
        assert [r.ids(k).tolist() for k in range(4)] == [d.tolist() for d in docs]
    import zstandard

    assert len(zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(path.read_bytes())) == 4 * 300
    spoiled = bytearray(path.read_bytes())
    spoiled[-15] ^= 1  # a checksum in the seek table... of the index frame; the first data frame's lies further ahead
    spoiled[-9 - 12 * 6 + 8] ^= 1
    path.write_bytes(bytes(spoiled))
    with pafs.LocalFileSystem().open_input_file(str(path)) as source, pytest.raises(ValueError, match="checksum"):
        token_store.StoreReader(source).ids(0)
    path.write_bytes(b"nothing of the kind")
    with pafs.LocalFileSystem().open_input_file(str(path)) as source, pytest.raises(ValueError):
        token_store.StoreReader(source)


def test_empty_tables(spark, docs):
    assert token_store.read_store(token_store.write_store(docs([]), NAMES[0], 2)).count() == 0
    assert packing.pack(docs([]), NAMES[1], 2).count() == 0


def best_cost(pos, penalty, window, exact_from, each=1.0):
    exact = {1 << k for k in range(40) if exact_from <= 1 << k <= window}
    f = [0.0]
    for j in range(1, len(pos)):
        f.append(min(f[i] + (0 if pos[j] - pos[i] in exact else window - (pos[j] - pos[i])) for i in range(j) if pos[j] - pos[i] <= window) + penalty[j] + each)
    return f[-1]


def cost(ends, pos, penalty, window, exact_from, each=1.0):
    at, total, pen = 0, 0.0, dict(zip(pos.tolist(), penalty.tolist(), strict=True))
    for e in ends.tolist():
        n = e - at
        assert 0 < n <= window
        total += (0 if n >= exact_from and n & (n - 1) == 0 else window - n) + pen[e] + each
        at = e
    assert at == pos[-1]
    return total


def test_the_plan_is_the_cheapest():
    rng = random.Random(4)
    for _ in range(150):
        docs = np.cumsum([rng.randrange(1, 60) for _ in range(rng.randrange(1, 12))])
        sentences = np.array(sorted(rng.sample(range(1, int(docs[-1]) + 1), min(int(docs[-1]), rng.randrange(10)))), np.int64)
        pos, penalty = packing.cuts(docs, sentences, 32, 4.0, 64.0)
        assert (np.diff(pos) <= 32).all()
        ends = packing.plan(pos, penalty, 32, 8)
        assert cost(ends, pos, penalty, 32, 8) == pytest.approx(best_cost(pos, penalty, 32, 8))


@pytest.mark.parametrize("block", [1 << 19, 50])
def test_every_id_lies_in_one_piece(spark, docs, block):
    rows = edge_texts()
    pieces = packing.pack(docs(rows), NAMES[1], 2, block_tokens=block, with_ids=True).collect()
    sequences = {}
    for p in pieces:
        own = np.frombuffer(p.ids, "<u4")
        assert len(own) == p.length > 0 and zlib.crc32(p.ids) == p.ids_crc32
        sequences.setdefault(p.sequence_id, []).append(p)
    for own in sequences.values():
        own.sort(key=lambda p: p.offset)
        at = 0
        for p in own:
            assert p.offset == at
            at += p.length
        assert at <= 4096
    order = sorted(pieces, key=lambda p: (p.sequence_id, p.offset))
    assert [p.doc_id or -1 for p in order] == sorted(p.doc_id or -1 for p in order)
    stream = np.concatenate([np.frombuffer(p.ids, "<u4") for p in order]).tolist()
    expect = {i: [*plain(NAMES[1], t), 2] for i, t in rows}
    assert stream == [x for i in sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0)) for x in expect[i]]
    assert all(p.doc_tokens == len(expect[p.doc_id]) and p.start + p.length <= p.doc_tokens for p in pieces)
