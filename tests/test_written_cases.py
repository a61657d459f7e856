"""Written sentences of the default script, and what the cue, gate, prefix and evidence rules must give for each."""

import pytest
from pyspark.sql import functions as F

from folio.operators import evaluation, mentions, names, segments

CUES = [
    ("{}说：", "{}"), ("忽然{}尖声叫道：", "{}"), ("{}叹了口气，说：", "{}"), ("他还是劝道：", None), ("{}惨叫一声", None), ("众人齐声道：", None), ("饶有兴致道：", None), ("{}却说道：", "{}"), ("走到门口，{}开玩笑道：", "{}"), ("没有道：", None), ("没有动词", None), ("{}推开门道：", "{}"), ("{}叹了口气道：", "{}"), ("{}又轻声说道：", "{}"), ("推开门，道：", None),
]


@pytest.mark.parametrize("name", ["张三", "李四", "雷老虎", "王小明"])
def test_who_is_cued_with_nobody_known(spark, name):
    rows = spark.createDataFrame([(i, c.replace("{}", name)) for i, (c, _) in enumerate(CUES)], "i int, t string")
    got = {r.i: r.s for r in rows.select("i", segments.cue_speaker(F.col("t")).alias("s")).collect()}
    assert got == {i: s and s.replace("{}", name) for i, (_, s) in enumerate(CUES)}


GATED = [
    ("李寄舟", 100, 20, 5, None, None), ("李寄舟询", 12, 1, 0, "NAME_PLUS_RESIDUE", "李寄舟"), ("虽然不知", 10, 4, 2, "FUNCTION_WORD", None), ("李寄舟大师", 9, 5, 2, None, None), ("雷老虎", 5, 2, 2, "CUE_ONLY", None), ("闻天明", 8, 5, 0, "NO_INDEPENDENT", None), ("赵钱", 50, 9, 3, None, None), ("赵钱孙李", 20, 9, 3, "NAME_PLUS_RESIDUE", "赵钱"),
    ("赵钱孙李周", 10, 9, 3, None, None), ("没见过", 0, 0, 0, "BAD_FINAL", None), ("钱多多", 0, 0, 0, "CUE_ONLY", None),
]


@pytest.mark.parametrize("keys", [[], ["book"]])
def test_the_gate_decides_in_order(spark, keys):
    rows = spark.createDataFrame([(b, *g[:4]) for b in (1, 2) for g in GATED if keys or b == 1], "book int, surface string, total int, right_kinds int, independent int")
    got = sorted((r.book, r.surface, r.reject or "", r.residue_of or "") for r in names.gate(rows, keys=keys).collect())
    assert got == sorted((b, g[0], g[4] or "", g[5] or "") for b in (1, 2) for g in GATED if keys or b == 1)


PREFIXES = [("abcx", "abc/x"), ("abcxy", "abcx/y"), ("abcxyz", "abcx/yz"), ("ab", None), ("abc", None), ("qabcx", None)]


def test_longest_prefix(spark):
    asked = spark.createDataFrame([(s,) for s, _ in PREFIXES], "surface string")
    found = names.longest_prefix(asked, spark.createDataFrame([("abc",), ("abcx",)], "surface string"))
    assert {r.surface: f"{r.name}/{r.rest}" for r in found.collect()} == {s: cut for s, cut in PREFIXES if cut}


def test_who_is_called_introduced_and_cued(spark):
    rows = spark.createDataFrame([(1, 1, "张三，走", ""), (1, 2, "我是李四", ""), (1, 3, "", "王五说。王五问"), (1, 4, None, None)], "book int, pos int, text string, context string")
    got = sorted((r.pos, r.surface, r.kind) for r in mentions.mention_rows(rows, ["book"], "pos").collect())
    assert got == [(1, "张三", "vocative"), (2, "李四", "self_intro"), (3, "王五", "cue"), (3, "王五", "cue")]


def test_counters_of_a_surface(spark):
    docs = spark.createDataFrame([(1, "见张三：走。张三张三"), (2, None)], "doc_id int, text string")
    r = names.surface_evidence(docs, spark.createDataFrame([("张三",), ("李四",)], "surface string"), overlapping=False, takers="见").where("surface = '张三'").first()
    assert (r.total, r.quote_right, r.punct_left, r.person_object) == (3, 1, 1, 1)


def test_probe_of_the_gate(spark):
    gated = spark.createDataFrame([("a", None), ("b", "CUE_ONLY"), ("c", "CUE_ONLY"), ("d", None), ("d2", None)], "surface string, reject string")
    labels = spark.createDataFrame([("a", "name"), ("a", "name"), ("b", "name"), ("d", "fragment")], "surface string, label string")
    got = sorted(tuple(r) for r in evaluation.gate_probe(gated, labels).collect())
    assert got == [("fragment", "ACCEPTED", 2, 0.333333), ("fragment", "CUE_ONLY", 1, 0.333333), ("name", "ACCEPTED", 1, 0.5), ("name", "CUE_ONLY", 1, 0.5)]


def test_checks_of_answers_and_token_rates(spark):
    rows = spark.createDataFrame(
        [(True, 1, 1, "A", ["A"], ["E1"], ["E1", "E2"], ["A", "A"]), (True, 2, 3, "UNKNOWN", [], None, None, ["A", "B"]), (True, 4, None, "Z", ["A"], ["E9"], ["E1"], ["Z"]), (None, 5, 5, "A", ["A"], [], [], ["A"])],
        "parsed boolean, asked int, answered int, speaker string, candidates array<string>, evidence array<string>, given array<string>, repeats array<string>",
    )
    assert tuple(evaluation.judge_counters(rows, []).first()) == (4, 3, 1, 2, 2, 2, 1)
    timed = spark.createDataFrame([("m", 10, 4, 1.0), ("m", 20, 8, 2.0), ("z", 1, 1, 0.0)], "model string, tokens_in int, tokens_out int, seconds double")
    assert sorted(tuple(r) for r in evaluation.token_rates(timed, ["model"]).collect()) == [("m", 2, 10.0, 4.0, 15.0, 6.0), ("z", 1, None, None, 1.0, 1.0)]


PAIRS = [("张三就是李四。", "t/-"), ("张三来了。李四就是王五", "f/-"), ("李四，人称张三", "t/-"), ("张三不是李四", "f/DENIED"), ("张三打李四", "f/FOUGHT"), ("没有", "f/-")]


def test_sentences_that_say_that_two_names_are_one(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(PAIRS)], "i int, t string")
    a, b, text = F.lit("张三"), F.lit("李四"), F.col("t")
    said = F.concat_ws("/", F.when(names.alias_evidence(a, b, text, "就是|人称"), "t").otherwise("f"), F.coalesce(names.contradiction_evidence(a, b, text, [("DENIED", "不是"), ("FOUGHT", "打|杀")]), F.lit("-")))
    assert {r.i: r.s for r in rows.select("i", said.alias("s")).collect()} == {i: e for i, (_, e) in enumerate(PAIRS)}


MENTION_CASES = [
    ([], "x", "NONE"), (["a", "b", "c"], "x", "multi_person"), (["Tom"], "x", "foreign_name"), (["一二三四五六"], "x", "long_name"), (["王将军"], "x", "role_title"), (["家丁"], "x", "group"), (["灵"], "x", "nonhuman"), (["张三"], "我是张三", "first_appearance"), (["张三"], "张三走", "chinese_name"), (["张三", "李四"], "x", "chinese_name"),
]


def test_nine_classes_of_mentions(spark):
    rows = spark.createDataFrame([(i, m, t) for i, (m, t, _) in enumerate(MENTION_CASES)], "i int, m array<string>, t string")
    got = {r.i: r.kind for r in rows.select("i", mentions.mention_class(F.col("m"), F.col("t")).alias("kind")).collect()}
    assert got == {i: kind for i, (_, _, kind) in enumerate(MENTION_CASES)}


@pytest.mark.parametrize(
    ("cues", "said", "texts", "scene", "want"),
    [
        (["张三"], ["刘三刀", "新人"], ["雷老虎上前一步，又退", "张三。路人"], ["雷老虎"], [("张三", "CUE"), ("刘三刀", "AI_MENTION"), ("雷老虎", "RECENT_MENTION"), ("新人", "NEW_MENTION")]),
        ([], ["新人"], ["刘三刀刀光一闪"], ["雷老虎"], [("刘三刀", "RECENT_MENTION"), ("雷老虎", "SCENE_ACTIVE"), ("新人", "NEW_MENTION")]),
        ([], [], [], [], []),
    ],
)
def test_store_of_candidates(spark, cues, said, texts, scene, want):
    rows = spark.createDataFrame([(cues, said, texts, scene)], "cues array<string>, said array<string>, texts array<string>, scene array<string>")
    entities = F.array(*map(F.lit, ["张三", "刘三刀", "雷老虎"]))
    store = mentions.candidate_store(F.col("cues"), F.col("said"), mentions.head_mentions(F.col("texts"), entities), F.col("scene"), entities)
    assert [tuple(c) for c in rows.select(store.alias("s")).first().s] == want
