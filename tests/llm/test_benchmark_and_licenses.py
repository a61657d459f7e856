"""Decontamination and license scans against plain versions."""

import random
import time

import pytest
from helpers import alnum_words, decontaminate as plain

from folio.llm import decontaminate, license_scan, queries
from folio.llm.common import table
from folio.llm.suffix_automaton import SuffixAutomaton


def test_automaton_knows_all_substrings_and_no_other():
    rng = random.Random(2)
    for _ in range(60):
        sequences = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 9))] for _ in range(4)]
        sam = SuffixAutomaton(sequences)
        have = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        seen, todo = set(), [((), 0)]
        while todo:
            at, v = todo.pop()
            for w, to in sam.next[v].items():
                seen.add((*at, w))
                todo.append(((*at, w), to))
        assert seen == have


def test_query_equals_plain(spark, sf):
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    assert {tuple(r) for r in queries.op9_decontaminate(spark, sf).collect()} == set(plain(docs, items))


@pytest.mark.parametrize("block", [8, 500_000])
@pytest.mark.parametrize("window", [3, 5])
def test_random_items(spark, block, window):
    rng = random.Random(window)
    some = lambda n: " ".join(rng.choice("ABcd") for _ in range(rng.randint(0, n)))
    items, docs = [(i, some(9)) for i in range(8)] + [(8, None), (9, "..")], [(i, some(40)) for i in range(60)] + [(60, None), (61, "")]
    got = decontaminate.report(decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), window, block))
    assert {tuple(r) for r in got.collect()} == set(plain(docs, items, window))


def test_removal(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (2, "tiny item")], "item_id long, text string")
    rest = " ".join(f"word{i}" for i in range(20))
    rows = [(1, f"{rest}. One, two three four-five six seven eight nine ten! {rest}", 9), (2, "one two three four five six seven eight nine ten", 9), (3, f"é Tiny. ITEM {rest}", 9), (4, None, 5), (5, rest, 9)]
    got = {r.doc_id: r for r in decontaminate.remove_spans(spark.createDataFrame(rows, "doc_id long, text string, n_chars long"), items).collect()}
    assert sorted(got) == [1, 3, 4, 5]
    assert got[1].text == f"{rest}. ! {rest}" and got[1].n_chars == len(got[1].text)
    assert got[3].text == f"é  {rest}"
    assert got[4].text is None and got[4].n_chars == 5
    assert decontaminate.remove_spans(spark.createDataFrame(rows, "doc_id long, text string, n_chars long"), items.limit(0)).count() == 5


def test_removal_in_blocks_equals_one_block(spark):
    word = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    one, two, rest = word("a", 12), word("b", 12), word("r", 16)
    late = " ".join([*(f"a{i}" for i in range(6, 12)), *(f"c{i}" for i in range(6))])  # overlaps the first item's words
    joined = " ".join([*(f"r{i}" for i in range(11, 16)), *(f"s{i}" for i in range(5))])  # is in a text only once the first item is cut
    items = spark.createDataFrame([(1, one), (2, two), (3, late), (4, joined)], "item_id long, text string")
    s = word("s", 16)
    texts = [f"{one} {rest} {two}", f"{s} {rest} {one} {s} {rest}", f"{s} {rest} {one} {word('c', 6)} {s}", f"{rest} {s}", None, "", f"{rest}. {two}! {s}"]
    rows = [(None if i == 6 else i, t, "de", 9) for i, t in enumerate(texts)] + [(1, texts[1], "en", 9), (1, rest, "fr", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")
    removed = lambda block: sorted(map(tuple, decontaminate.remove_spans(docs, items, block_words=block).collect()), key=str)
    whole = removed(500_000)
    assert removed(12) == whole and removed(24) == whole
    assert [r for r in whole if r[0] == 0] == []  # 24 of 40 words
    assert [r[1] for r in whole if r[0] == 1 and r[2] == "de"] == [f"{s} {rest}  {s} {rest}"]
    assert [r[1] for r in whole if r[0] == 2] == [f"{s} {rest}  {s}"]


def test_long_items_are_cut_and_rows_kept(spark):
    rng = random.Random(6)
    long = [rng.choice("abcd") for _ in range(60)]
    items = spark.createDataFrame([(1, " ".join(long)), (2, "z z z z z z"), (None, "q q q q q"), (2, "z z z z z z")], "item_id long, text string")
    texts = [" ".join(long[i : i + 12]) for i in range(0, 50, 3)] + ["z z z z z z z", None, "", "q q q q q"]
    docs = spark.createDataFrame([(i % 7 if i % 5 else None, t, 1) for i, t in enumerate(texts + texts)], "doc_id long, text string, sha int")
    got = lambda block: sorted((tuple(r) for r in decontaminate.contamination(docs, items, 5, block).collect()), key=str)
    whole = got(500_000)
    assert len(whole) == 2 * len(texts) and got(7) == whole and got(20) == whole
    assert decontaminate.contamination(docs.limit(0), items, 5, 7).count() == 0
    cut = lambda block: sorted((tuple(r) for r in decontaminate.remove_spans(docs, items, 5, 0.9, block).collect()), key=str)
    assert cut(7) == cut(500_000)


def licenses(text):
    w, found = alnum_words(text), []
    for phrase, label in license_scan.PHRASES.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return len(w), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None), ",".join(sorted({x for _, x in found}))


def test_license_query(spark, sf):
    want = {(r.doc_id, *licenses(r.text)) for r in table(spark, sf, "documents").collect()}
    got = queries.op10_license_scan(spark, sf).collect()
    assert {(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got} == want
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)


def plain_scan(text, templates, min_match, max_gap, cover):
    """Each template by itself: stretches by trying every substring of it, chains by trying every earlier stretch."""
    w = alnum_words(text)
    out = []
    for label, t in [(label, alnum_words(t)) for label, t in templates]:
        known = {tuple(t[i:j]) for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        longest = [next(n for n in range(end, -1, -1) if n == 0 or tuple(w[end - n : end]) in known) for end in range(len(w) + 1)]
        ends = [e for e in range(1, len(w) + 1) if longest[e] and (e == len(w) or longest[e + 1] != longest[e] + 1)]
        stretches = [(e, longest[e], p) for e in ends if longest[e] >= min(min_match, len(t)) for p in range(longest[e], len(t) + 1) if t[p - longest[e] : p] == w[e - longest[e] : e]]
        chains = []
        for e, n, p in stretches:
            mine = (n, -(e - n), -e)
            for k, (e2, _, p2) in enumerate(stretches[: len(chains)]):
                shared = max(0, e2 - (e - n))
                if e2 < e and e - n - e2 <= max_gap and shared < n and 0 <= p - n + shared - p2 <= max_gap:
                    mine = max(mine, (chains[k][0] + n - shared, chains[k][1], -e))
            chains.append(mine)
        if chains and max(chains)[0] / len(t) >= cover:
            c, s, e = max(chains)
            out.append((label, -s, -e, c / len(t)))
    return sorted(out)


def test_license_chains_equal_plain():
    rng = random.Random(11)
    for _ in range(300):
        templates = [(f"l{k}", " ".join(rng.choice("abcdef") for _ in range(rng.randint(2, 14)))) for k in range(4)]
        phrases = {"a b": "x", "c d e": "y"}
        text = " ".join(rng.choice("abcdefz") for _ in range(rng.randint(0, 12)))
        for _ in range(3):
            t = rng.choice(templates)[1].split()
            cut = rng.randint(0, len(t))
            text += " " + " ".join([*t[:cut], *rng.choice([[], ["z"], ["z", "z", "z", "z"]]), *t[cut + rng.randint(0, 2) :]])
        matcher = license_scan.LicenseMatcher(templates, phrases, 2, 2, 0.3)
        assert matcher.match([x.encode() for x in alnum_words(text)])[1] == plain_scan(text, templates, 2, 2, 0.3), text


def test_a_template_inside_another_is_found_with_it():
    templates = [("x", "a b c d e f g h i j k l"), ("y", "d e f g"), ("z", "k l m n"), ("x2", "c d e f g h q")]
    found = lambda text: [(s[0], s[1], s[2], s[3]) for s in license_scan.LicenseMatcher(templates, {}).match(text.encode().split())[1]]
    assert found("a b c d e f g h i j k l") == [("x", 0, 12, 1.0), ("x2", 2, 8, 6 / 7), ("y", 3, 7, 1.0)]
    assert found("q d e f g q") == [("y", 1, 5, 1.0)]


def test_texts_of_one_word_take_linear_time():
    words = [b"w"] * 500_000
    matcher = decontaminate.ItemMatcher([(1, [b"w"] * 4000), (2, [b"w", b"w", b"v"])], 10)
    began = time.time()
    assert matcher.match(words) == ([(0, 500_000)], {1})
    assert time.time() - began < 20


def test_whole_licenses(spark):
    texts = dict(zip(license_scan.LICENSES, (t for _, t in license_scan.templates()[len(license_scan.NOTICES) :]), strict=True))
    assert len(alnum_words(texts["GPL-3"])) > 5000
    rows = [(k, f"intro {t} outro") for k, t in texts.items()] + [("half", texts["GPL-3"][:12000])]
    got = {r.doc_id: r for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    for k, label in license_scan.LICENSES.items():
        assert label in got[k].labels.split(",") and any(s.label == label and s.coverage == 1 for s in got[k].spans), k
    assert not any(s.label == "gpl" and s.end - s.start > 1000 for s in got["half"].spans)
    odd = spark.createDataFrame([(None, "MIT License"), (1, "MIT License"), (1, "MIT License"), (2, "")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.n_base) for r in license_scan.scan_licenses(odd).collect()) == [("1", 1), ("1", 1), ("2", 0), ("None", 1)]
    assert license_scan.scan_licenses(odd.limit(0)).count() == 0


def test_license_spans(spark):
    bsd = dict(license_scan.NOTICES)["bsd"]
    broken = bsd.replace("binary forms", "object code forms")
    rows = [(1, f"x y {bsd} z"), (2, f"x {broken}"), (3, "Redistribution and use in source"), (4, None), (5, "MIT  license, apache-license; General\nPublic License mit license"), (6, "x Licensed under CC BY-NC 4.0. y")]
    got = {r.doc_id: r for r in license_scan.scan_licenses(spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, labels string")).collect()}
    n = len(alnum_words(bsd))
    assert [(s.label, s.start, s.end, s.coverage) for s in got[1].spans] == [("bsd", 2, 2 + n, 1.0)]
    assert got[2].labels == "bsd" and got[2].spans[0].end == 1 + n + 1 and 0.8 < got[2].score < 1
    assert got[3].labels == "" and got[4].score == 0 and got[4].n_words == 0
    assert (got[5].n_base, got[5].first_word, got[5].last_word, got[5].labels) == (4, 0, 7, "apache,gpl,mit")
    assert got[6].labels == "cc-by-nc" and got[6].base_labels == ""
