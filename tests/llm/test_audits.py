"""Nearest neighbours, source divergence and prefix tries against plain versions."""

import math
from collections import Counter

import duckdb
import numpy as np
import pytest
from plain_trie import prefix_rows

from folio.llm import nearest, prefix_trie, queries, source_divergence


def plain_nearest(rows, query, k=20):
    out = []
    for q, v in rows:
        if q % query == 0:
            near = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in rows if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(near)]
    return out


def recall(got, want):
    return len({(r[0], r[2]) for r in got} & {(r[0], r[2]) for r in want}) / len(want)


VECTORS = "vec_id long, embedding array<float>, score string, rank int, code string, v int"


def test_recall_on_the_tables(spark, sf):
    got = [tuple(r) for r in queries.op11_nearest_neighbours(spark, sf).collect()]
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = plain_nearest(rows, 20)
    assert len(got) == len(want) and recall(got, want) >= 0.9
    vectors = dict(rows)
    assert all(math.isclose(s, math.fsum(a * b for a, b in zip(vectors[q], vectors[i], strict=True)), abs_tol=1e-12) for q, _, i, s in got)
    for q in {r[0] for r in got}:
        own = sorted(r[1:] for r in got if r[0] == q)
        assert [r[0] for r in own] == list(range(1, 21)) and own == sorted(own, key=lambda r: (-r[2], r[1]))


@pytest.mark.parametrize("scale", [0.0, 1.0])
def test_recall_with_clusters_copies_and_norms(spark, scale, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK", 200)
    monkeypatch.setattr(nearest, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(5)
    hub = rng.normal(size=12)
    x = np.vstack([rng.normal(size=(500, 12)), hub + 0.01 * rng.normal(size=(250, 12)), np.tile(hub, (150, 1))]).astype(np.float32)
    x *= np.exp(scale * rng.normal(size=(len(x), 1)) * (np.arange(len(x)) < 750)[:, None]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = [tuple(r) for r in nearest.nearest(spark.createDataFrame([(*r, "s", 1, "c", 2) for r in rows], VECTORS)).collect()]
    want = plain_nearest(rows, 20)
    assert len(got) == len(want) and len({(r[0], r[2]) for r in got}) == len(got)
    by = {(r[0], r[2]): r[3] for r in got}
    # copies tie, so the scores that are found count
    near = sum(by.get((q, i)) is not None or any(abs(g[3] - s) < 1e-9 for g in got if g[0] == q) for q, _, i, s in want)
    assert near / len(want) >= 0.9


def test_odd_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (None, [1.0, 1.0]), (6, []), (7, [1.0, 1.0]), (7, [1.0, 1.0]), (8, [1.0, 1.0]), (40, [9.0, 9.0, 9.0])]
    got = sorted(tuple(r) for r in nearest.nearest(spark.createDataFrame([(*r, "s", 1, "c", 2) for r in rows], VECTORS)).collect())
    assert got == [(0, 1, 7, 1.0), (0, 2, 8, 1.0), (0, 3, 20, 0.0), (20, 1, 7, 2.0), (20, 2, 8, 2.0), (20, 3, 0, 0.0)]
    assert nearest.nearest(spark.createDataFrame([], VECTORS)).collect() == []


def plain_divergence(rows, least=30, top=50):
    count, docs, groups = Counter(), Counter(), set()
    for lang, source, text in rows:
        words = "".join(c if "a" <= c <= "z" or ord(c) >= 128 else chr(ord(c) + 32) if "A" <= c <= "Z" else " " for c in text or "").split(" ")
        words = [w for w in words if w]
        groups.add((lang or "", source or ""))
        count.update((lang or "", source or "", w) for w in words)
        docs.update((lang or "", w) for w in set(words))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for (la, t), n in docs.items() if la == lang and n >= least]
        sources = sorted(s for la, s in groups if la == lang)

        def p(counts):
            low = sum(counts.values()) + 5 * len(kept)
            return {t: 1 + 1_000_000_000 * (counts[t] + 5) // low for t in kept}

        own = {s: {t: count[lang, s, t] for t in kept} for s in sources}
        ps = {s: p(own[s]) for s in sources}
        q = p({t: sum(own[s][t] for s in sources) for t in kept})
        for s in sources:
            pairs = sorted((-sum(abs(ps[s][t] - ps[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            terms = sorted((q[t] - ps[s][t], t.encode()) for t in kept if own[s][t] and ps[s][t] > q[t])[:top]
            out += [(lang, s, part, i.decode(), -v, r + 1) for part, found in (("pair", pairs), ("term", terms)) for r, (v, i) in enumerate(found)]
    return sorted(out)


DOCS = "text string, lang string, source string, term string, n int, value int"


@pytest.mark.parametrize(("least", "top", "width"), [(1, 5, 256), (3, 2, 4), (2, 50, 1), (99, 50, 256)])
def test_divergence(spark, monkeypatch, least, top, width):
    monkeypatch.setattr(source_divergence, "SOURCES", width)
    monkeypatch.setattr(source_divergence, "ENTRIES", 20)
    rng = np.random.default_rng(least)
    rows = [(" ".join(f"w{chr(97 + int(x))}É" if x % 3 else chr(65 + int(x)) for x in rng.zipf(1.4, 30) % 26), f"l{i % 3}", f"s{i % 7 * (i % 5 > 0)}") for i in range(120)]
    rows += [(None, None, None), ("", "l0", None), ("alone alone", "l9", "s"), ("a B  a", "l0", "s1"), ("a B  a", "l0", "s1"), ("word " * 5000, "l1", "s2")]
    got = sorted(tuple(r) for r in source_divergence.divergence(spark.createDataFrame([(*r, "t", 1, 2) for r in rows], DOCS), least, top).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == plain_divergence([(la, s, t) for t, la, s in rows], least, top)


def test_divergence_of_nothing(spark):
    assert source_divergence.divergence(spark.createDataFrame([], DOCS)).collect() == []


def test_divergence_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = queries.op12_source_divergence(spark, sf)
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(queries.oracle_sql()["op12_source_divergence"]).select(*got.columns).fetchall())


TURNS = "conv_id long, turn long, role string, text string, node string, depth int, label int"


def trie(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "n", 1, 2) for r in rows], TURNS)
    return sorted(tuple(-1 if v is None else v for v in r) for r in prefix_trie.prefix_trie(df, **kw).collect())


@pytest.mark.parametrize("shard", [1, 10, 20_000])
def test_prefix_trie(spark, shard):
    rng = np.random.default_rng(3)
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"word {int(rng.integers(2))} " * 3) for c in range(90) for t in range(int(rng.integers(1, 7)))]
    rows += [(c, t, "user", f"the same prompt {t}") for c in range(200, 260) for t in range(40 if c % 2 else 41)]
    rows += [(None, 0, "user", "x"), (301, None, None, None), (301, 1, None, ""), (301, 1, None, ""), (-27, 0, "user", "z"), (-20, 0, "user", "y"), (-1, 0, "user", "q"), (302, 0, "u", "é" * 20_000)]
    assert trie(spark, rows, shard=shard) == prefix_rows(rows)


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    assert trie(spark, []) == []
    rows = [(c, 0, "user", "a") for c in range(21, 40)]
    assert trie(spark, rows) == prefix_rows(rows)


def test_trie_on_the_tables(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(tuple(-1 if v is None else v for v in r) for r in queries.op13_prefix_trie(spark, sf).collect()) == prefix_rows(rows)


def test_louds_of_a_small_forest():
    parent = np.array([-1, 0, 0, 2, -1])
    order, stops = prefix_trie.level_order(parent, np.arange(5))
    assert order.tolist() == [0, 4, 1, 2, 3] and stops == [2, 4, 5]
    bits = prefix_trie.louds(np.bincount(parent[parent >= 0], minlength=5)[order], 2)
    # two roots; two children, none; none, one; none
    assert "".join("01"[int(b)] for b in bits) == "110" "110" "0" "0" "10" "0"
    assert [(-1 if p < 0 else int(order[p])) for p in prefix_trie.parents(bits)] == [-1, -1, 0, 0, 2]
