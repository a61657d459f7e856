"""Interval stabbing against a plain version, with hot keys in parts and without; dense keys, unordered pairs and context lists."""

import random

import pytest

from folio.operators import asof, identity, segments
from folio.sources import sinks


def plain(points, intervals, closed):
    out = []
    for k, x, n in points:
        inside = [(s, t, i) for j, s, e, t, i in intervals if k is not None and j == k and x is not None and s is not None and s <= x and (e is None or x < e + closed) and (e is None or s < e + closed)]
        out.append((k, x, n, max(inside)[2] if inside else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("leaf", [30, 10**6])
@pytest.mark.parametrize("closed", [True, False])
def test_stab(spark, monkeypatch, leaf, closed):
    monkeypatch.setattr(asof, "LEAF", leaf)
    rng = random.Random(leaf + closed)
    key = lambda: rng.choice(["hot"] * 6 + ["a", "b", "c", None])
    intervals = []
    for i in range(500):
        s = rng.choice([None, rng.randrange(1000), rng.randrange(1000), 500])
        length = rng.choice([-1, 0, 1, 3, 50, 400, None])
        intervals.append((key(), s, None if s is None or length is None else s + length, i, i))
    intervals += [("nest", 10 + i, 900 - i, 1000 + i, 1000 + i) for i in range(200)] + [("same", 5, 9, 2000 + i, 2000 + i) for i in range(40)]
    points = [(rng.choice([key(), "nest", "same", "none"]), rng.choice([None, *(rng.randrange(-5, 1010) for _ in range(8))]), n) for n in range(900)]
    points += points[:20]
    got = asof.stab(spark.createDataFrame(points, "k string, x long, row int"), spark.createDataFrame(intervals, "k string, s long, e long, t long, v long"), "k", "x", "s", "e", ["v"], closed, "t")
    assert got.columns == ["k", "x", "row", "held_v"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(points, intervals, closed)


def test_stab_of_nothing(spark):
    points, intervals = spark.createDataFrame([(1, 2)], "k int, x int"), spark.createDataFrame([], "k int, s int, e int, i int")
    assert [tuple(r) for r in asof.stab(points, intervals, "k", "x", "s", "e", ["i"]).collect()] == [(1, 2, None)]
    assert asof.stab(points.limit(0), intervals, "k", "x", "s", "e", ["i"]).count() == 0


def test_dense_keys(spark):
    rows = [(a, b) for a in [None, "x", "y", "z"] for b in [None, 1, 2, 7] for _ in range(3)]
    df = spark.createDataFrame(rows, "a string, b int").repartition(5)
    got = {(r.a, r.b, r.id) for r in sinks.with_dense_key(df, "id", "a", "b").collect()}
    assert [(a, b) for a, b, _ in sorted(got, key=lambda r: r[2])] == [(a, b) for a in [None, "x", "y", "z"] for b in [None, 1, 2, 7]]
    assert tuple(sinks.key_faults(sinks.dense_keys(df, "id", "a", "b"), "id").first()) == (16, 0, 0, 0)
    assert tuple(sinks.key_faults(spark.createDataFrame([(1,), (1,), (4,), (0,)], "id long"), "id").first()) == (4, 1, 1, 1)
    assert sinks.dense_keys(df.limit(0), "id", "a", "b").count() == 0


def test_ordered_pair(spark):
    df = spark.createDataFrame([(2, 1, "k"), (1, 2, "k"), (3, 3, "k"), (None, 1, "k")], "a int, b int, c string")
    assert [tuple(r) for r in identity.ordered_pair(df, "a", "b").collect()] == [(1, 2, "k"), (1, 2, "k")]


def test_causal_lists(spark):
    rng = random.Random(2)
    rows = [(k, i, rng.choice([f"t{i}", None]), rng.choice([f"s{i}", None, None, None]), rng.choice([None, [], [f"m{i}"], [f"a{i}", None, f"b{i}"], [f"x{i}"] * 8])) for k in range(3) for i in range(40)]
    got = segments.causal_lists(spark.createDataFrame(rows, "k int, i int, t string, s string, m array<string>"), ["k"], ["i"], "t", "s", "m")
    for r in got.collect():
        past = [x for x in rows if x[0] == r.k and x[1] < r.i]
        found = [m for x in rows if x[0] == r.k and x[1] <= r.i for m in x[4] or [] if m]
        assert (r.previous, r.recent_speakers, r.recent_mentions) == ([x[2] for x in past if x[2]][-5:], [x[3] for x in past if x[3]][-3:], found[-6:])
    assert got.count() == len(rows)


def test_candidate_pairs_of_long_lists(spark):
    df = spark.createDataFrame([(k, i, f"c{i}") for k, n in (("a", 150), ("b", 1), ("c", 3)) for i in range(n)], "k string, idx int, candidate string")
    got = [tuple(r) for r in identity.candidate_pairs(df, ["k"]).select("k", "i", "a", "j", "b").collect()]
    assert sorted(got) == sorted((k, i, f"c{i}", j, f"c{j}") for k, n in (("a", 150), ("b", 1), ("c", 3)) for j in range(n) for i in range(j))
