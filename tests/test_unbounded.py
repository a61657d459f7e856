"""Operators that once had a cap, past that cap."""

import random

import pytest
from pyspark.sql import functions as F

from folio.operators import names, segments, versions


def test_a_chain_of_150(spark):
    edges = spark.range(150).select(F.col("id").alias("dependency"), (F.col("id") + 1).alias("dependent"))
    got = {(r.node, r.depth) for r in versions.downstream(edges, spark.createDataFrame([(0,)], "node long")).collect()}
    assert got == {(i, i) for i in range(1, 151)}
    proposed = spark.createDataFrame([(0, 150), (151, 150)], "dependent long, dependency long")
    assert {(r.dependent, r.cycle) for r in versions.would_cycle(edges, proposed).collect()} == {(0, True), (151, False)}


def test_a_diamond_of_40_levels(spark):
    edges = [(a, b) for i in range(40) for a in (2 * i, 2 * i + 1) for b in (2 * i + 2, 2 * i + 3)]
    got = {(r.node, r.depth) for r in versions.downstream(spark.createDataFrame(edges, "dependency int, dependent int"), spark.createDataFrame([(0,)], "node int")).collect()}
    assert got == {(n, n // 2) for n in range(2, 82)}


def test_many_children_and_null_ends(spark):
    edges = spark.range(1, 1_200_001).select(F.lit(0).cast("long").alias("dependency"), F.col("id").alias("dependent")).union(spark.sql("SELECT CAST(NULL AS LONG), 5L"))
    assert versions.downstream(edges, spark.createDataFrame([(0,), (None,)], "node long")).agg(F.count("*"), F.max("depth")).first() == (1_200_000, 1)
    assert versions.downstream(edges.limit(0), spark.createDataFrame([(0,)], "node long")).count() == 0


def test_roots_below_roots(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "dependency int, dependent int")
    roots = spark.createDataFrame([(1,), (2,)], "node int")
    assert {(r.node, r.depth) for r in versions.downstream(edges, roots).collect()} == {(2, 1), (3, 1), (1, 2)}
    assert {(r.root, r.node, r.depth) for r in versions.reach(edges, roots).collect()} == {(1, 2, 1), (1, 3, 2), (1, 1, 3), (2, 3, 1), (2, 1, 2), (2, 2, 3)}


def test_invalidation_far_below(spark):
    edges = spark.range(120).select(F.col("id").alias("dependency"), (F.col("id") + 1).alias("dependent"))
    events = spark.createDataFrame([("BOOK", 100), ("LINE", 3)], "scope string, revision_id long")
    revisions = spark.range(125).withColumnRenamed("id", "revision_id")
    assert {r.revision_id for r in versions.invalidate(edges, events, revisions).where("invalid").collect()} == {3, *range(100, 121)}


def move_to_front(values, size):
    out, now = [], []
    for v in values:
        out.append(now[:size])
        if v is not None:
            now = [v, *(x for x in now if x != v)]
    return out


def test_recent_distinct_from_far_back(spark):
    rng = random.Random(3)
    cases = {1: ["c", *"ab" * 40], 2: [rng.choice("abcdefgh") if rng.random() > 0.1 else None for _ in range(120)], 3: [None, None, "x"]}
    rows = [(k, i, v, "kept") for k, vs in cases.items() for i, v in enumerate(vs)]
    for size in (3, 16):
        got = segments.recent_distinct(spark.createDataFrame(rows, "k int, i int, v string, _place0 string"), ["k"], ["i"], "v", size).orderBy("k", "i")
        assert got.columns == ["k", "i", "v", "_place0", "recent"]
        have = {}
        for r in got.collect():
            have.setdefault(r.k, []).append(r.recent)
        assert have == {k: move_to_front(vs, size) for k, vs in cases.items()}


def plain_evidence(texts, surface):
    places = [(t, i) for t in texts if t is not None for i in range(len(t)) if t.startswith(surface, i)]
    sides = [(t[i - 1 : i] if i else "", t[i + len(surface) : i + len(surface) + 1]) for t, i in places]
    cue = sum(r in (":", "?") for _, r in sides)
    return len(sides), cue, len({r for _, r in sides}), sum(x in ("", " ", "\n") and r not in (":", "?") for x, r in sides), len(sides) - cue


@pytest.mark.parametrize("small", [0, 200_000])
def test_surfaces_of_any_length(spark, monkeypatch, small):
    monkeypatch.setattr(names, "SMALL", small)
    monkeypatch.setattr(names, "BATCH_CHARS", 300)
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab: \n𝒳é") for _ in range(n)) for n in (1, 2, 63, 64, 65, 66, 129, 500)] + ["", None, "\x00a\x00", "elephant? elephant", "x" * 62 + "elephant: elephants"]
    surfaces = ["a", "ab", "elephant", "ba𝒳", "a" * 9, "é"]
    got = names.surface_evidence(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string"), spark.createDataFrame([(s,) for s in surfaces], "surface string"), cue_heads=":?", punct=" \n")
    assert {r.surface: (r.total, r.cue_bound, r.right_kinds, r.independent, r.free) for r in got.collect()} == {s: plain_evidence(texts, s) for s in surfaces}
    hits = names.mentions(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string"), spark.createDataFrame([(s,) for s in surfaces], "surface string"), ["doc_id"])
    assert {(r.doc_id, r.surface, r.at) for r in hits.collect()} == {(i, s, t.index(s) + 1) for i, t in enumerate(texts) if t for s in surfaces if s in t}


def test_longest_matches_from_the_left(spark):
    words = spark.createDataFrame([("ab",), ("abc",), ("cd",), ("bcde",), ("e",)], "surface string")
    texts = spark.createDataFrame([(1, "abcde abcd"), (2, "bcdee"), (3, None), (4, "xyz")], "k int, text string")
    assert [(r.k, r.nth, r.at, r.surface) for r in names.longest_matches(texts, words, ["k"]).orderBy("k", "nth").collect()] == [(1, 0, 1, "abc"), (1, 1, 5, "e"), (1, 2, 7, "abc"), (2, 0, 1, "bcde"), (2, 1, 5, "e")]
    assert names.longest_matches(texts, words.limit(0), ["k"]).count() == 0
