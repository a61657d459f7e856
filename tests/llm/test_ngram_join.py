"""N-gram Jaccard join against a plain all-pairs version."""

import random

import pytest
from helpers import near_duplicates as plain

from folio.llm import ngram_join, queries
from folio.llm.common import table
from folio.llm.components import connected_components


def as_dict(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_query_equals_plain(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    assert as_dict(queries.op3_ngram_jaccard_join(spark, sf)) == plain(rows)


def corpus(seed, n=160):
    """Families of near copies around the threshold, a passage shared by half of all, short texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.randint(4, 60))] for _ in range(12)]
    out = []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        if rng.random() < 0.5:
            w += passage
        out.append((i * 3 % n, " ".join(w).upper() if rng.random() < 0.2 else "\n".join(w)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("hot", [3, 64])
def test_families_around_the_threshold(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(ngram_join, "HOT_IN_CHUNK", hot)
    monkeypatch.setattr(ngram_join, "CHUNK_WORDS", 700)
    monkeypatch.setattr(ngram_join, "PAIRS_FOR_ENTRY", 0 if hot == 3 else 1000)
    monkeypatch.setattr(ngram_join, "PIVOTS", (2, 4, 9) if hot == 3 else ngram_join.PIVOTS)
    rows = corpus(seed)
    assert as_dict(ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == plain(rows)


def test_edges(spark):
    rows = [(5, None), (6, ""), (7, " \t\n"), (8, "one"), (9, "ONE"), (10, "a b c d"), (11, "a b c d e"), (12, "x\x0by\x0cz\rw v"), (13, "X y z W v"), (14, "é b c d e"), (15, "É b c d e")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows] + [(None, "one", 1)], "doc_id long, text string, key int")
    assert as_dict(ngram_join.near_duplicates(docs)) == plain(rows)
    assert ngram_join.near_duplicates(docs.limit(0)).count() == 0


def test_repeated_ids_are_one_union(spark):
    word = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    rows = [(1, word(0, 30)), (1, word(100, 130)), (2, word(0, 32)), (3, word(100, 131)), (1, word(0, 30)), (4, "a b"), (4, "a b"), (5, "a  b")]
    got = as_dict(ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == {1: (52, 1), 2: (28, 2), 3: (27, 3), 4: (1, 4), 5: (1, 4)}


def test_weights_of_more_than_16_bits(spark):
    rng = random.Random(5)
    long = [str(rng.randrange(10**9)) for _ in range(150_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[:130_000])), (3, " ".join(long[20_000:] + long[:100])), (4, " ".join(long[:70_000]))]
    got = as_dict(ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == plain(rows)


def test_many_near_copies_of_texts(spark, monkeypatch):
    rng = random.Random(7)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(60)] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(ngram_join, "CHUNK_WORDS", 2000)
    assert as_dict(ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == plain(rows)


@pytest.mark.parametrize("block", [3, 2000])
def test_a_family_of_short_texts_under_one_template(spark, monkeypatch, block):
    rng = random.Random(13)
    monkeypatch.setattr(ngram_join, "LIST_BLOCK", block)
    monkeypatch.setattr(ngram_join, "PAIRS_FOR_ENTRY", 10**9)  # one round of hubs, then the rest
    rows = []
    for i in range(260):
        kind, own = rng.randrange(3), rng.choice([1, 2, 3, 5, 8])
        rows.append((i, " ".join([*(f"t{k}" for k in range(30)), *(f"k{kind}w{k}" for k in range(20)), *(f"o{rng.randrange(4)}" for _ in range(own))])))
    assert as_dict(ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == plain(rows)


def test_keep_one_with_clashing_and_unordered_columns(spark):
    frame = spark.sql("SELECT id % 3 AS doc_id, 'own text ' || id % 3 AS text, map('k', id) AS _doc, id AS `a.b`, id AS _repeated FROM range(6)")
    got = ngram_join.keep_one(frame)
    assert got.columns == frame.columns and sorted(r.doc_id for r in got.collect()) == [0, 1, 2]


def test_keep_one(spark):
    long = " ".join(f"w{i}" for i in range(200))
    rows = [(3, long, 7), (2, long + " more", None), (2, long + " more", None), (None, long, 1), (9, None, 2), (9, None, 2), (4, "own text of five words", 3)]
    got = sorted(ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string, n_chars long")).collect(), key=str)
    assert [(r.doc_id, r.n_chars) for r in got] == [(2, None), (4, 3), (9, 2), (None, 1)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (7, 7), (None, 3), (100, 90)]
    got = {(r.node, r.component) for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(i, 1) for i in range(1, 41)} | {(i, 90) for i in (90, 95, 100)}
