"""Vector search, host graph, preference pairs."""

from __future__ import annotations

import random

import brute
import numpy as np
import pytest

from runlake.llm import ann_tree, linkgraph, preference


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, leaf string")


def told(df):
    return sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in df.collect())


QUERY = "vec_id % 50 = 0"


def test_search_by_brute_force_with_copies_and_ties(spark):
    rng = np.random.default_rng(12)
    rows = [(k, rng.normal(size=8).astype("f4").tolist()) for k in range(300)]
    rows += [(k, rows[7][1]) for k in range(300, 420)] + [(k, (np.array(rows[50][1]) * 2).tolist()) for k in range(420, 424)]
    got = told(ann_tree.search(vectors(spark, rows), QUERY, recall=1.0, sample=200, leaf=16, branch=4, calibrate=64, part=20))
    want = sorted((q, n, i, round(s, 9)) for q, n, i, s in brute.neighbours(rows))
    assert got == want


def test_many_scaled_copies_tie_by_id(spark):
    rng = np.random.default_rng(16)
    v = rng.normal(size=8).astype("f4")
    ids = rng.permutation(80).tolist()
    rows = [(i, (v * np.float32(2.0 ** (k - 40))).tolist()) for k, i in enumerate(ids)] + [(k, rng.normal(size=8).astype("f4").tolist()) for k in range(80, 120)]
    got = told(ann_tree.search(vectors(spark, rows), QUERY, recall=1.0, sample=200, leaf=16, branch=4, calibrate=64))
    assert got == sorted((q, n, i, round(s, 9)) for q, n, i, s in brute.neighbours(rows))
    assert [i for q, _, i, _ in got if q == 50] == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("part", [10, 4096])
def test_vectors_of_extreme_length_cost_nobody_a_neighbour(spark, part):
    rng = np.random.default_rng(21)
    plain = [(k, rng.normal(size=8).tolist()) for k in range(102)]
    scale = {k: (-565, 565, -1040, 1000)[k % 4] for k in range(0, 102, 3)}  # about 1e-170, 1e170, and near the ends of what a double holds
    rows = [(k, np.ldexp(v, scale.get(k, 0)).tolist()) for k, v in plain]
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, leaf string")
    got = told(ann_tree.search(table, QUERY, recall=1.0, sample=200, leaf=16, branch=4, calibrate=64, part=part))
    exact = [(k, np.ldexp(v, -scale.get(k, 0)).tolist()) for k, v in rows]  # what rounding near zero has left of them
    assert got == sorted((q, n, i, round(s, 9)) for q, n, i, s in brute.neighbours(exact)) and len(got) == 15


def test_ties_are_settled_by_id_in_any_order():
    rng = np.random.default_rng(17)
    v = rng.normal(size=8)
    for _ in range(20):
        ids = rng.permutation(80).tolist()
        theirs = v * 2.0 ** (rng.permutation(80)[:, None] - 40)
        near = ann_tree._unit(v[None, :]) @ ann_tree._unit(theirs).T
        best = ann_tree.nearest(near[0], v, theirs, [[i] for i in ids], 3, 5)
        assert [x for _, x, _ in best] == [0, 1, 2, 4, 5] and all(ids[c] == x for _, x, c in best)


@pytest.mark.parametrize("parts", [1, 3, 1_000])
def test_classes_of_one_and_of_many(spark, parts):
    schema = "vec_id long, leaf int, class binary, v array<float>"
    rows = [(i, i % 3, bytes([i]), [float(i)]) for i in range(20)]
    rows += [(i, 1, b"copies", [0.5]) for i in range(90, 20, -1)] + [(200, 0, b"pair", [2.5]), (100, 2, b"pair", [2.5]), (7, 1, bytes([7]), [7.0])]
    want = {bytes([i]): ([i], [float(i)]) for i in range(20)} | {b"copies": ([21, 22, 23, 24, 25, 26], [0.5]), b"pair": ([100, 200], [2.5])}
    got = ann_tree.classes(spark.createDataFrame(rows, schema), 5, parts=parts).collect()
    assert len(got) == len(want) and {bytes(r["class"]): (r.ids, r.v) for r in got} == want
    assert {bytes(r["class"]): r.leaf for r in got}[b"pair"] == 0
    alone = ann_tree.classes(spark.createDataFrame(rows[:20], schema), 5)
    assert sorted((r.leaf, r.ids) for r in alone.collect()) == sorted((i % 3, [i]) for i in range(20))
    assert "Exchange" not in alone._jdf.queryExecution().executedPlan().toString()
    assert ann_tree.classes(spark.createDataFrame([], schema), 5).count() == 0


def test_recall_on_many_vectors(spark):
    rng = np.random.default_rng(13)
    centres = rng.normal(size=(40, 16))
    m = (centres[rng.integers(40, size=4000)] + 0.7 * rng.normal(size=(4000, 16))).astype("f4")
    got = told(ann_tree.search(vectors(spark, [(k, v.tolist()) for k, v in enumerate(m)]), QUERY, recall=0.95, sample=1500, leaf=40))
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 4000, 50):
        near = unit @ unit[q]
        near[q] = -2
        hits += len(set(np.argsort(-near)[:5].tolist()) & {i for a, _, i, _ in got if a == q})
    assert len(got) == 400 and hits >= 0.9 * 400


def test_search_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.1]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (0, [1.0, 0.0]), (100, [0.0, 0.0])]
    got = ann_tree.search(vectors(spark, rows), QUERY).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == [(0, 1, 50), (50, 1, 0)]
    assert ann_tree.search(vectors(spark, []), QUERY).count() == 0
    assert ann_tree.search(vectors(spark, [(1, [1.0]), (2, [1.0])]), QUERY).count() == 0
    assert ann_tree.search(vectors(spark, [(0, [1.0, -0.0])]), QUERY).count() == 0
    same = ann_tree.search(vectors(spark, [(k, [1.0, 1.0]) for k in range(60)]), QUERY).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in same) == [(0, n, n) for n in range(1, 6)] + [(50, n + 1, n) for n in range(5)]


def test_best_bins_come_first():
    rng = np.random.default_rng(14)
    m = rng.normal(size=(600, 6))
    m = (m / np.linalg.norm(m, axis=1, keepdims=True)).astype("f4")
    tree = ann_tree.Tree.fit(m, branch=4, leaf=20)
    leaves = tree.assign(m)
    orders = [list(tree.order(v)) for v in m[:50]]
    assert all(sorted(o) == list(range(tree.n_leaves)) for o in orders)
    assert np.mean([o.index(leaves[k]) for k, o in enumerate(orders)]) < tree.n_leaves / 8
    assert ann_tree.Tree.fit(np.ones((200, 3), "f4"), leaf=10).n_leaves >= 1


def pages(spark, rows):
    return spark.createDataFrame([(k, u, h, "x", 1) for k, u, h in rows], "page_id long, url string, html string, host string, n int")


@pytest.mark.parametrize(("url", "host", "path", "rule", "verdict"), [
    ("http://a.example.com/en/x", "a.example.com", "/en/x", "example.com/en/", "block"),
    ("HTTP://WWW.Example.COM/en/x?q=/fr/", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
    ("https://b.www.example.com/en/#top", "b.www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("https://example.com/EN/", "example.com", "/EN/", "com/", "allow"),
    ("https://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
    ("https://com", "com", "", None, "allow"),
    ("https://x.net/es/a", "x.net", "/es/a", "net/es/", "block"),
    ("https://x.net?to=/es/", "x.net", "", None, "allow"),
    ("x.net/es/", "", "", None, "allow"),
    ("a://b://c/d", "b:", "//c/d", None, "allow"),
    (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("://", "", "", None, "allow"),
    ("http://ÄX.org/\nz", "Äx.org", "/\nz", None, "allow"),
])
def test_rules(spark, url, host, path, rule, verdict):
    (r,) = linkgraph.filter_urls(pages(spark, [(1, url, None)])).collect()
    assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict)


def test_trust_and_distrust_travel(spark):
    link = lambda h: f'<p><a href="https://{h}/">x</a> <A HREF=//{h}/y>y</A></p>'
    rows = [
        (1, "https://bad.net/es/1", None), (2, "https://bad.net/es/2", ""), (3, "https://bad.net/xx/", "<a href='/inside'>"),
        (4, "https://farm.org/", link("bad.net")), (5, "https://good.com/", link("fine.org")), (6, "https://fine.org/", "no links"),
        (7, "https://mixed.org/", link("bad.net") + link("good.com") * 9), (7, "https://mixed.org/", None), (None, None, link("bad.net")),
    ]
    got = {(r.page_id, r.path): r for r in linkgraph.filter_urls(pages(spark, rows)).collect()}
    assert got[3, "/xx/"].verdict == "block" and got[4, "/"].verdict == "block"
    assert got[6, "/"].verdict == "allow" and got[6, "/"].trust > 0
    assert got[7, "/"].verdict == "allow" and got[None, ""].verdict == "allow"
    assert linkgraph.filter_urls(pages(spark, [])).count() == 0


def test_many_linkers_of_one_blocked_host(spark):
    link = lambda h: f'<a href="https://{h}/">x</a>'
    rows = [(0, "https://bad.net/es/1", link("fine.org")), (1, "https://second.org/", link("farm7.org")), (2, "https://passing.org/", link("bad.net") + link("fine.org") * 9), (3, "https://fine.org/", None)]
    rows += [(10 + k, f"https://farm{k}.org/", link("bad.net")) for k in range(30)]
    got = {r.host: r for r in linkgraph.filter_urls(pages(spark, rows)).collect()}
    assert all(got[f"farm{k}.org"].verdict == "block" and abs(got[f"farm{k}.org"].distrust - 0.85) < 1e-3 for k in range(30))
    assert got["second.org"].verdict == "block" and abs(got["second.org"].distrust - 0.85**2) < 1e-3
    assert got["passing.org"].verdict == got["fine.org"].verdict == "allow"


def plain_ranks(edges, seeds, damping=0.85):
    """Personalised PageRank to convergence, by dictionaries; what isn't passed on goes back to the seeds."""
    out = {}
    for (a, _), n in edges.items():
        out[a] = out.get(a, 0) + n
    total = sum(seeds.values())
    if not total:
        return {}
    rank = dict.fromkeys(seeds, 0.0)
    for _ in range(300):
        back = damping * sum(r for h, r in rank.items() if h not in out) / total
        passed = dict.fromkeys(rank, 0.0)
        for (a, b), n in edges.items():
            passed[b] = passed.get(b, 0) + damping * rank.get(a, 0) * n / out[a]
        rank = {h: (1 - damping + back) * seeds.get(h, 0) + p for h, p in passed.items()}
    return rank


def test_propagation_by_brute_force(spark):
    rng = random.Random(15)
    hosts = [f"h{k}" for k in range(12)]
    edges = {(a, b): rng.randrange(1, 5) for a in hosts[:9] for b in hosts if a != b and rng.random() < 0.25}
    seeds = {h: rng.randrange(4) for h in hosts}
    rank = plain_ranks(edges, seeds)
    got = linkgraph.propagate(spark.createDataFrame([(*e, n) for e, n in edges.items()], "src string, dst string, n long"), spark.createDataFrame(list(seeds.items()), "host string, seed long"), 0.85, 60)
    told_ = {r.host: r["rank"] / linkgraph.UNIT for r in got.collect()}
    assert all(abs(told_.get(h, 0) - rank[h]) < 0.01 * sum(seeds.values()) for h in hosts)
    assert abs(sum(told_.values()) - sum(seeds.values())) < 0.05 * sum(seeds.values())


def test_whole_verdicts_by_brute_force_on_a_linked_table(spark):
    rng = random.Random(23)
    names = [f"h{k}.{rng.choice(['org', 'org', 'net', 'com'])}" for k in range(14)]
    rows = []
    for k in range(120):
        links = "".join(f'<a href="https://{rng.choice(names)}/">x</a>' for _ in range(rng.choice([0, 1, 3])))
        rows.append((k, f"https://{rng.choice(names)}{rng.choice(['/es/', '/en/', '/fr/x', '/'])}", links))
    pages_of, edges = {h: [] for h in names}, {}
    for k, url, html in rows:
        host, path = url[8:].split("/", 1)
        pages_of[host].append((k, "allow" if host.endswith(".com") else "block" if host.endswith(".net") and ("/" + path).startswith(("/es/", "/fr/")) else None))
        for dst in html.split("https://")[1:]:
            if (dst := dst.split("/")[0]) != host:
                edges[host, dst] = edges.get((host, dst), 0) + 1
    count = lambda v: {h: sum(x == v for _, x in own) for h, own in pages_of.items()}
    good, bad = count("allow"), count("block")
    trust, against = plain_ranks(edges, good), plain_ranks({(b, a): n for (a, b), n in edges.items()}, bad)
    out = {a: sum(n for (x, _), n in edges.items() if x == a) for a in names}
    meets = {h: 0.0 for h in names}
    for _ in range(300):
        share = {h: bad[h] / len(own) if own else 0 for h, own in pages_of.items()}
        meets = {h: share[h] + (1 - share[h]) * 0.85 * sum(n / out[h] * meets[b] for (a, b), n in edges.items() if a == h) for h in names}
    decided = 0
    got = {r.page_id: r for r in linkgraph.filter_urls(pages(spark, rows)).collect()}
    for h, own in pages_of.items():
        for k, verdict in own:
            t, d = trust[h] / len(own), max(against[h] / len(own), meets[h])
            assert abs(got[k].trust - t) < 0.1 and abs(got[k].distrust - d) < 0.1
            if verdict or (abs(d - 0.5) > 0.1 and abs(d - t) > 0.1):
                assert got[k].verdict == (verdict or ("block" if d > t and d >= 0.5 else "allow"))
                decided += not verdict and got[k].verdict == "block"
    assert decided


def turns(spark, rows):
    return spark.createDataFrame([(*r, "x", 3) for r in rows], "conv_id long, turn long, role string, text string, part string, sub int")


def test_pairs_by_hand(spark):
    rows = [
        (0, 0, "system", "S"), (0, 1, "user", "Q"), (0, 2, "assistant", "good <|end|>"), (0, 3, "user", "thanks"),
        (9, 0, "system", "S"), (9, 1, "user", "Q"), (9, 2, "assistant", "bad"), (9, 2, "assistant", "bad"),
        (12, 0, "system", "S"), (2, 0, "user", "alone"), (2, 1, None, None), (2, None, "assistant", "last"), (None, 0, "user", "lost"),
        (4, 0, "user", "same"), (5, 0, "user", "same"), (3, 0, "user", "only"),
    ]
    told_ = preference.preferences(turns(spark, rows)).collect()
    got = {r.pair_id: r for r in told_ if r.piece == 0}
    assert [(r.pair_id, r.chosen) for r in told_ if r.piece] == [(2, "<|assistant|>\nlast<|end|>\n")]  # a null turn is the last one
    assert {k: r.rejected_id for k, r in got.items()} == {0: 9, 4: 5, 2: 3, 12: None}
    one = got[0]
    assert one.prompt == "<|system|>\nS<|end|>\n<|user|>\nQ<|end|>\n" and one.n_prompt == 2
    assert one.chosen == "<|assistant|>\ngood < |end|><|end|>\n<|user|>\nthanks<|end|>\n"
    assert [one.chosen[s.a : s.b] for s in one.chosen_mask] == ["good < |end|><|end|>"]
    assert [one.rejected[s.a : s.b] for s in one.rejected_mask] == ["bad<|end|>"]
    assert got[2].n_prompt == 0 and got[2].chosen == "<|user|>\nalone<|end|>\n<|unknown|>\n<|end|>\n" and got[2].rejected == "<|user|>\nonly<|end|>\n"
    assert (got[4].n_prompt, got[4].chosen, got[4].rejected, got[4].chosen_mask) == (1, "", "", [])
    assert got[12].prompt == "" and got[12].chosen == "<|system|>\nS<|end|>\n" and got[12].rejected == ""
    assert preference.preferences(turns(spark, [])).count() == 0


def conversations(rng):
    """Many that begin alike, some of them alike for long, one of hundreds of turns, one turn number that hundreds of rows share."""
    rows = []
    for c in range(60):
        first = rng.choice(["hello", "hello", "hi", f"own {c}"])
        rows += [(c, t, rng.choice(["user", "assistant", None]), first if t == 0 else rng.choice(["yes", "no", "a|b <|end|>", "", "é𝄞", None])) for t in range(rng.randrange(1, 7))]
    rows += [(70 + c, t, "assistant" if t % 2 else "user", f"turn {t}" if t < 150 else f"{c} {t}") for c in range(2) for t in range(200)]
    return rows + [(80, None, "assistant", f"lost {k}") for k in range(150)] + [(None, 1, "user", "x")] + rows[:20]


def test_pairs_against_sql_by_broadcast_and_by_shuffle(spark):
    import duckdb
    import pandas as pd

    rows = conversations(random.Random(21))
    con = duckdb.connect()
    con.register("frame", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    con.execute("create table conversations as select conv_id, turn, nullif(role, 'None') as role, nullif(text, 'None') as text from frame")
    want = con.execute(preference.ORACLE)
    names = [c[0] for c in want.description]
    want = sorted(map(repr, want.fetchall()))
    frame = turns(spark, rows)
    placed = preference.places(frame)
    sided = preference.pairs(placed)
    for most in (1_000_000, 0):
        told = preference.format_pairs(frame, preference.splits(placed, sided), most).collect()
        masks = lambda m: ",".join(f"{s.a}-{s.b}" for s in m)
        other = {r.pair_id: r.conv_id for r in sided.where("side = 'rejected'").collect()}
        got = [r.asDict() | {"rejected_id": other.get(r.pair_id), "chosen_mask": masks(r.chosen_mask), "rejected_mask": masks(r.rejected_mask)} for r in told]
        assert sorted(repr(tuple(r[n] for n in names)) for r in got) == want
    assert max(r.piece for r in told if r.pair_id == 70) == 3 and len([r for r in told if r.pair_id == 80 or r.piece > 10]) >= 3
    assert any(r.n_prompt > 1 for r in told)


def test_numbers_follow_the_order(spark):
    values = random.Random(22).sample(range(10_000), 500)
    got = preference.numbered(spark.createDataFrame([(v,) for v in values], "v long").repartition(7), "v").collect()
    assert {r.v: r.number for r in got} == {v: n for n, v in enumerate(sorted(values))}
