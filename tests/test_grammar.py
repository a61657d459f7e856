"""The template grammar against a plain enumeration of its products, and what it must survive."""

import itertools
import re

import pytest

from folio.operators import generators, grammar

TEMPLATES = [("d", "a", "{w} met {w:b} at {p}; {w} left."), ("d", "b", "no slot"), ("d", "c", "{p} and {p:x}"), ("e", "z", "{missing}"), ("d", "a", "{w} met {w:b} at {p}; {w} left."), ("d", "n", None), (None, "y", "free")]
FILLERS = [("d", "w", x) for x in ("Al", "Bo", "Cy{p}", "Al")] + [("d", "p", x) for x in ("inn", "pub", None)]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame(TEMPLATES, "domain string, template_id string, template string"), spark.createDataFrame(FILLERS, "domain string, pool string, filler string")


def quotas(spark, *rows):
    return spark.createDataFrame(list(rows), "domain string, quota long")


def product(template, pools):
    """All texts of a template, by trying every filler in every slot."""
    slots = list(dict.fromkeys(re.findall(r"\{([\w:]+)\}", template)))
    for chosen in itertools.product(*(pools[s.split(":")[0]] for s in slots)):
        used = [(s.split(":")[0], c) for s, c in zip(slots, chosen, strict=True)]
        if len(set(used)) == len(used):
            yield re.sub(r"\{([\w:]+)\}", lambda m, at=dict(zip(slots, chosen, strict=True)): at[m[1]], template)


def test_a_large_quota_gives_every_row_of_the_product_once(spark, tables):
    pools = {"w": ["Al", "Bo", "Cy{p}"], "p": ["inn", "pub"]}
    want = sorted(t for template in ("{w} met {w:b} at {p}; {w} left.", "no slot", "{p} and {p:x}") for t in product(template, pools))
    assert sorted(r.text for r in grammar.generate(*tables, quotas(spark, ("d", 10**6), ("e", 5)), 7).collect()) == want


def test_small_templates_give_their_share_away(spark, tables):
    got = {r.template_id: r.drawn for r in grammar.shared(grammar.sized(*tables), quotas(spark, ("d", 9), ("e", 5), ("none", 3))).collect()}
    assert got == {"a": 6, "b": 1, "c": 2, "z": 0}
    assert grammar.generate(*tables, quotas(spark, ("d", 0), ("d2", None)), 7).count() == 0


@pytest.mark.parametrize("quota", [1, 2, 3, 4, 7, 14])
def test_quotas_are_met(spark, tables, quota):
    rows = grammar.generate(*tables, quotas(spark, ("d", quota)), 3).collect()
    assert len(rows) == len({r.text for r in rows}) == quota


def test_spans_are_where_fillers_stand(spark, tables):
    for r in grammar.generate(*tables, quotas(spark, ("d", 15)), 7).collect():
        assert all(r.text[s.start : s.end] == s.surface == r.fillers[s.slot] for s in r.spans)
        assert [s.slot for s in r.spans] == re.findall(r"\{([\w:]+)\}", r.template)


def test_too_large_templates_are_refused(spark):
    t = spark.createDataFrame([("d", "big", "".join(f"{{p{i}}}" for i in range(8)))], "domain string, template_id string, template string")
    f = spark.range(300).selectExpr("'d' AS domain", "explode(array('p0','p1','p2','p3','p4','p5','p6','p7')) AS pool", "concat('x', id) AS filler")
    with pytest.raises(Exception, match="too many rows"):
        grammar.sized(t, f).collect()


def test_both_levels_of_held_out_texts(spark):
    words = spark.createDataFrame([("Ann",), ("Anna",), ("Bob",)], "surface string")
    rows = spark.createDataFrame([(1, "Ann ran"), (2, "Bob sat"), (3, "Bob sat"), (4, ""), (5, None), (6, "Anna sat, Bob sat")], "id int, text string")
    masked = grammar.masked_text(rows, words, ["id"])
    assert {r.id: r.skeleton for r in masked.collect()} == {1: "X ran", 2: "X sat", 3: "X sat", 4: "", 5: None, 6: "X sat, X sat"}
    held = spark.createDataFrame([("Anna ran", "X ran"), (None, None)], "text string, skeleton string")
    assert sorted(r.id for r in grammar.distinct_from(masked, held, ["id"]).collect()) == [2, 4, 6]
    assert sorted(r.id for r in grammar.distinct_from(masked, held.limit(0), ["id"]).collect()) == [1, 2, 4, 6]


def test_contrasts_change_one_place_and_the_label(spark):
    rows = spark.createDataFrame([(1, "he ran home", "GO"), (2, "ran, ran", "GO"), (3, "he ran", "STAY"), (4, None, "GO"), (5, "he ran", None)], "id int, text string, label string")
    got = {(r.id, r.text, r.label, r.evidence) for r in grammar.contrasts(rows, [("stop", "ran", "stood", "STAY")]).collect()}
    assert got == {(1, "he stood home", "STAY", "stood"), (5, "he stood", "STAY", "stood")}


def test_relabelled_rates(spark):
    rows = spark.createDataFrame([("s", "Ann ran", []), ("t", "Bob", ["Bob"])], "sample_id string, text string, mentions array<string>").selectExpr("*", "size(mentions) = 0 AS was_empty", "'k' AS k")
    answers = spark.createDataFrame([("s", ["Ann", "Zed"])], "sample_id string, mentions array<string>")
    assert generators.none_rates(generators.relabel_empty(rows, answers), ["k"]).first()[:] == ("k", 2, 1, 0)
