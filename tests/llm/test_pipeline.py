"""The pipeline's stages one by one against plain versions, and all of them on the driver's smallest tables."""

from __future__ import annotations

import os
import random

import brute
import numpy as np
import pytest
from brute import edge_texts

import corpus_pipeline
from runlake.llm import importance, queries
from runlake.llm.tokens import encoder, ids_of

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(20)
    prose = lambda n: " ".join(rng.choice(["the", "of", "and", "tamo", "reli", "sunta", "molire", "lita"]) + rng.choice(["", "", "s", "re"]) for _ in range(n))
    item = " ".join(f"exam{k}" for k in range(16))
    rows = [(k, prose(80)) for k in range(120)]
    rows += [(300 + k, rows[k][1]) for k in range(10)] + [(400, rows[5][1].upper())]
    rows += [(500, prose(20) + " " + item), (501, prose(400) + " " + item), (502, "password=abcdefgh " + prose(30))]
    rows += [(600 + k, prose(30) + " vile scum wretch " + prose(30)) for k in range(40)]
    rows += [(i if i is None else 700 + i, t) for i, t in edge_texts()]
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(100)] + [(600 + k, 1, 1) for k in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_every_stage_against_a_plain_version(spark, tables):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "secrets", "packing"]
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, rows = docs.columns, pairs(docs)
    kept = corpus_pipeline.quality(spark, docs, tables)
    told = [(r.doc_id, r.kept) for r in importance.select(docs, spark.read.parquet(f"{tables}/labels.parquet")).collect()]
    assert kept.columns == columns
    gone = {i for i, k in told if not k}
    rows = [r for r in rows if r[0] not in gone]
    assert pairs(kept) == rows
    assert len({i for i in gone if i is not None and 600 <= i < 640}) >= 36 and len([i for i in gone if i is not None and i < 120]) <= 6

    kept = corpus_pipeline.near_dedup(spark, kept, tables)
    assert kept.columns == columns
    place = lambda r: (r[0] is None, r[0] or 0)
    rows.sort(key=place)
    heads = brute.groups([brute.fingerprint(t) for _, t in rows])
    rows = sorted({n: rows[n] for n in heads}.values(), key=str)
    assert pairs(kept) == rows

    kept = corpus_pipeline.decontaminated(spark, kept, tables)
    item = [(1, " ".join(f"exam{k}" for k in range(16)))]
    rows = [r for r in rows if not brute.contamination(r[1], item)[4]]
    assert kept.columns == columns and pairs(kept) == rows
    assert 500 not in dict(rows) and 501 in dict(rows)

    kept = corpus_pipeline.without_secrets(spark, kept, tables)
    got = pairs(kept)
    assert kept.columns == columns and [i for i, _ in got] == [i for i, _ in rows]
    assert all(a == b for (i, a), (_, b) in zip(got, rows, strict=True) if not brute.secrets(b))
    assert dict(got)[502].startswith("[SECRET] ")
    assert all(r.n_chars == len(r.text or "") for r in kept.collect())

    pieces = corpus_pipeline.packed(spark, kept, tables).collect()
    tokens = {}
    for p in sorted(pieces, key=lambda p: p.start):
        tokens.setdefault(p.doc_id, []).append(p.length)
    enc = encoder("word_bpe_49k.json")
    assert {i: sum(n) for i, n in tokens.items()} == {i: len(ids_of(enc.encode(t))) + 1 for i, t in got}


def test_run_writes_each_stage_and_gives_the_last(spark, tables):
    out = corpus_pipeline.run(spark, tables)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 0
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_on_an_empty_table(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, tables)
        assert out.count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables here")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations", "pages", "embeddings"):
        con.execute(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = queries.queries()[name](spark, DATA)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(repr(tuple(r)) for r in got.select(*columns).collect()) == sorted(map(repr, want.fetchall()))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables here")
def test_whole_tables_are_answered(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    ids = sorted(r.doc_id for r in docs.select("doc_id").collect())
    for name in ("op2_simhash", "op4_importance", "op7_langid", "op8_secret_scan"):
        assert sorted(r.doc_id for r in queries.queries()[name](spark, DATA).select("doc_id").collect()) == ids
    found = queries.queries()["op1_ann_tree"](spark, DATA).collect()
    vectors = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    want = {(q, i) for q, _, i, _ in brute.neighbours([(r.vec_id, r.embedding) for r in vectors])}
    assert len(found) == len(want) and len({(r.query_id, r.vec_id) for r in found} & want) >= 0.9 * len(want)
    assert np.isfinite([r.score for r in found]).all()
