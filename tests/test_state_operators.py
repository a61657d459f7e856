"""State machines, identity, decisions, versions, rendering, sampling and streams."""

import json
import random

import pytest
from pyspark.sql import functions as F

from folio.operators import asof, decisions, evaluation, generators, identity, names, render, sampling, state, versions
from folio.streaming import voice


def test_voice_engine_table():
    e = state.VoiceEngine(base="b")
    steps = [(("VOICE_OVERRIDE", "CLEAR", None, None, None), "ORPHAN_CLEAR"), (("VOICE_OVERRIDE", "SET", "hoarse", None, None), "START"), (("VOICE_OVERRIDE", "SET", "hoarse", None, None), "CONTINUE"), (("VOICE_OVERRIDE", "SET", "UNKNOWN", "child", "UTTERANCE"), "REPLACE"), (("NONE", None, None, None, None), "END"), (("PERFORMANCE", None, "cry", None, None), "PERFORMANCE"), (("VOICE_OVERRIDE", "SET", None, None, None), "START"), (("VOICE_OVERRIDE", "CLEAR", None, None, None), "END")]
    for event, action in steps:
        assert e.apply(*event) == action
    assert e.effective == "b"


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"e{rng.randrange(3)}", i, rng.choice(["NONE", "PERFORMANCE", "VOICE_OVERRIDE", "VOICE_OVERRIDE"]), rng.choice(["SET", "CLEAR"]), rng.choice(["a", "b", "UNKNOWN"]), None, rng.choice(["UTTERANCE", "UNTIL_CLEAR"])) for i in range(60)]
    schema = "entity string, seq long, kind string, operation string, style string, target string, scope string"
    df = spark.createDataFrame(rows, schema)
    want = {(r.entity, r.seq): (r.action, r.override) for r in state.run_engine(df, ["entity"], ["seq"]).collect()}
    for part in range(3):
        df.where((F.col("seq") >= part * 20) & (F.col("seq") < part * 20 + 20)).coalesce(1).write.json(str(tmp_path / "in" / str(part)))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(str(tmp_path / "in"))
    q = voice.voice_actions(stream).writeStream.format("memory").queryName("acts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.entity, r.seq): (r.action, r.override) for r in spark.table("acts").collect()}
    assert set(got) == set(want)


def test_reducer_and_timeline(spark):
    rows = [(1, 1, "SET", "x"), (1, 2, "SET", "x"), (1, 3, "SET", "y"), (1, 4, "CLEAR", None), (1, 5, "CLEAR", None), (1, 6, "SET", "z")]
    acts = state.reduce_overrides(spark.createDataFrame(rows, "entity int, at int, operation string, style string").withColumn("target", F.lit(None).cast("string")), ["entity"], ["at"])
    assert [r.action for r in acts.orderBy("at").collect()] == ["START", "CONTINUE", "REPLACE", "END", "NONE", "START"]
    spans = state.timeline(acts.withColumn("override", F.col("temp_key")), ["entity"], "at", "at").orderBy("start_at").collect()
    assert [(r.start_at, r.end_at, r.descriptor) for r in spans] == [(1, 3, "x"), (3, 4, "y"), (6, None, "z")]


def test_recovered_speakers(spark):
    rows = [(1, 1, "a", False, ["b"]), (1, 2, None, False, []), (1, 3, None, True, ["c", "c", "d"]), (1, 4, None, False, []), (1, 5, None, True, None)]
    got = state.recover_speakers(spark.createDataFrame(rows, "k int, o int, speaker string, reset boolean, mentions array<string>"), ["k"], "o").orderBy("o").collect()
    assert [(r.speaker, r.how) for r in got] == [("a", "GIVEN"), ("a", "LAST"), ("b", "MODE"), ("b", "LAST"), ("c", "MODE")]


def test_recovered_speakers_equal_a_plain_walk(spark):
    """Gaps, resets, ties of mentions, empty and null values, in keys with one row and with many."""
    rng = random.Random(11)
    rows = [
        (k, o, rng.choice([None, None, None, "a", "b", ""]), rng.choice([True, False, False, None]), rng.choice([None, [], ["x"], ["y", "x"], ["z", "z", "x"], ["", None, "y"]]))
        for k in range(30) for o in range(rng.choice([1, 4, 25]))
    ]
    want = {}
    for k in range(30):
        last, seen = None, []
        for _, o, speaker, reset, names in (r for r in rows if r[0] == k):
            last = None if reset else last
            recent = [n for m in seen[-5:] for n in m]
            mode = max(sorted(set(recent)), key=recent.count) if recent else None
            got, how = (speaker, "GIVEN") if speaker is not None else (last, "LAST") if last else (mode, "MODE") if mode else (None, "NONE")
            last = got or last
            seen.append([n for n in names or [] if n])
            want[k, o] = got, how
    got = state.recover_speakers(spark.createDataFrame(rows, "k int, o int, speaker string, reset boolean, mentions array<string>"), ["k"], "o")
    assert {(r.k, r.o): (r.speaker, r.how) for r in got.collect()} == want


def test_asof_and_stab_equal_plain(spark):
    rng = random.Random(5)
    facts = [(rng.randrange(3), rng.randrange(40), i) for i in range(40)]
    points = sorted({(rng.randrange(4), rng.randrange(45)) for _ in range(60)})
    fdf, pdf = spark.createDataFrame(facts, "k int, at int, v int"), spark.createDataFrame(points, "k int, at int")
    got = {(r.k, r.at): r.asof_v for r in asof.asof_last(pdf, fdf, "k", "at", ["v"], tie="v").collect()}
    assert got == {(k, t): max(((a, v) for q, a, v in facts if q == k and a <= t), default=(0, None))[1] for k, t in points}
    spans = [(k, a, a + rng.randrange(12) if v % 4 else None, v) for k, a, v in facts]
    sdf = spark.createDataFrame(spans, "k int, s int, e int, v int")
    held = {(r.k, r.at): r.held_v for r in asof.stab(pdf, sdf, "k", "at", "s", "e", ["v"], tie="v").collect()}
    best = lambda k, t, rows: max(((s, v) for q, s, e, v in rows if q == k and s <= t and (e is None or t <= e)), default=(0, None))[1]
    assert held == {(k, t): best(k, t, spans) for k, t in points}
    closed = [x for x in spans if x[2] is not None]
    binned = asof.stab(pdf.union(pdf), spark.createDataFrame(closed, "k int, s int, e int, v int"), "k", "at", "s", "e", ["v"], tie="v")
    assert {(r.k, r.at): r.held_v for r in binned.collect()} == {(k, t): best(k, t, closed) for k, t in points}


def test_identity(spark):
    log = spark.createDataFrame([(1, "MERGE", 1, 2), (2, "MERGE", 2, 3), (3, "SPLIT", 3, None)], "seq int, action string, source int, target int").withColumn("book", F.lit(1))
    ents = spark.createDataFrame([(i,) for i in range(1, 6)], "entity int").withColumn("book", F.lit(1))
    got = {r.entity: r.cluster for r in identity.replay_merges(log, ents, ["book"]).collect()}
    assert got == {1: "cluster-1", 2: "cluster-2", 3: "cluster-3", 4: "entity-4", 5: "entity-5"}
    ev = spark.createDataFrame([(1, 2, "A", 1, 1.0, False), (2, 1, "A", 1, 0.7, False), (3, 4, "B", -1, 1.0, True), (5, 5, "A", 1, 9.0, False)], "a int, b int, relation string, sign int, strength double, hard boolean")
    pairs = identity.pair_evidence(ev, [])
    assert [(r.a, r.b) for r in identity.mergeable(pairs).collect()] == [(1, 2)]
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (7, 8)], "a int, b int")
    nodes = spark.createDataFrame([(i,) for i in range(1, 10)], "node int")
    assert {r.node: r.cluster for r in identity.clusters_by_links(links, nodes, lambda d: spark.createDataFrame(d.collect(), d.schema)).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6, 7: 7, 8: 7, 9: 9}


GOOD = {"segment_id": "S1", "speaker": "C1", "type": "DIALOGUE", "emotion": "SAD", "emotion_intensity": 0.4, "delivery": {"pace": "SLOW", "volume": "QUIET", "tone": "WARM"}, "voice_event": "SIGH", "evidence": ["E1"]}


@pytest.mark.parametrize(("raw", "outcome", "codes", "fixes"), [
    (json.dumps(GOOD), "ACCEPTED_ALL", [], []), (json.dumps(GOOD | {"speaker": "UNKNOWN"}), "VERIFY", [], []), (json.dumps(GOOD | {"emotion": "sad"}), "ACCEPTED_ALL", [], ["ENUM_CASE"]), ("```json\n" + json.dumps(GOOD) + "\n```", "ACCEPTED_ALL", [], ["CODE_FENCE_STRIPPED", "JSON_OBJECT_EXTRACTED"]),
    (json.dumps(GOOD)[:-1] + ",}", "ACCEPTED_ALL", [], ["TRAILING_COMMA"]), (json.dumps(GOOD).replace('"SAD"', "SAD"), "ACCEPTED_ALL", [], ["BARE_TOKEN_QUOTED"]), (json.dumps(GOOD | {"emotion": "HAPPY", "emotion_intensity": 3, "evidence": ["E9", "x"]}), "DOWNGRADE", ["EMOTION_INVALID", "EMOTION_INTENSITY_RANGE", "EVIDENCE_ID_INVALID", "EVIDENCE_ID_MISSING"], []),
    (json.dumps(GOOD | {"segment_id": "S2", "speaker": "C9"}), "REJECT", ["SEGMENT_ID_MISMATCH", "SPEAKER_ID_MISSING"], []), (json.dumps(GOOD | {"speaker": "NARRATOR"}), "REJECT", ["SPEAKER_TYPE_CONFLICT"], []), ("no json", "REJECT", ["JSON_PARSE_FAILED"], []), ('{"a": ', "REJECT", ["JSON_PARSE_FAILED"], []),
])
def test_decisions(spark, raw, outcome, codes, fixes):
    rows = spark.createDataFrame([(raw, "S1", ["C1", "C2"], ["E1"])], "raw string, token string, candidates array<string>, provided array<string>")
    r = decisions.validate(decisions.normalize(rows)).first()
    assert (r.outcome, r.hard + r.soft, r.fixes) == (outcome, codes, fixes)
    if outcome == "DOWNGRADE":
        assert (r.decision.emotion, r.decision.intensity, r.decision.evidence) == ("NEUTRAL", 0.5, [])


def test_codec_and_refs(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "id int, t string")
    back = decisions.decode_lines(decisions.encode_lines(df, ["id", "t"]).union(spark.createDataFrame([('{"schemaVersion":1,"id":9}',), ("{bad",)], "value string")), "id int, t string")
    assert sorted(map(tuple, back.collect()), key=str) == [(1, "x"), (2, None)]
    r = spark.range(1).select(decisions.speaker_ref(F.lit("C1"), F.create_map(F.lit("C1"), F.lit(42))).alias("a")).select("a", decisions.decode_ref(F.col("a")).alias("d")).first()
    assert (r.a, r.d.kind, r.d.id) == ("CHARACTER:42", "CHARACTER", 42)


def test_names(spark):
    text = "雷老虎说：好。雷老虎，来了。雷老虎走。深吸一口，雷老虎道。雷老虎们。"
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    surfaces = spark.createDataFrame([("雷老虎",), ("雷老虎走",), ("深吸",), ("因为",), ("钱多多",)], "surface string")
    ev = names.surface_evidence(docs, surfaces)
    got = {r.surface: (r.total, r.cue_bound, r.right_kinds, r.independent) for r in ev.collect()}
    assert got["雷老虎"] == (5, 2, 5, 3) and got["钱多多"] == (0, 0, 0, 0)
    gated = {r.surface: r.reject for r in names.gate(ev).collect()}
    assert gated["雷老虎"] is None and gated["因为"] == "FUNCTION_WORD" and gated["钱多多"] == "CUE_ONLY"
    assert names.surface_evidence(spark.createDataFrame([(1, "aaaa")], "doc_id int, text string"), spark.createDataFrame([("aa",)], "surface string"), overlapping=False).first().total == 2
    assert {(r.nth, r.surface) for r in names.longest_matches(spark.createDataFrame([(1, "abcab")], "k int, text string"), spark.createDataFrame([("a",), ("ab",), ("abc",)], "surface string"), ["k"]).collect()} == {(0, "abc"), (1, "ab")}


def plain_permutation(items, seed):
    mask, a, s = (1 << 64) - 1, list(items), seed
    for i in range(len(a) - 1, 0, -1):
        s = (s * 6364136223846793005 + 1442695040888963407) & mask
        j = (s >> 33) % (i + 1)
        a[i], a[j] = a[j], a[i]
    return a


def test_seeded_permutation(spark):
    rows = spark.createDataFrame([(s, [str(i) for i in range(n)]) for s in (0, 1, 12345678901) for n in (0, 1, 2, 7)], "s long, a array<string>")
    for r in rows.select("s", "a", sampling.lcg_permutation(F.col("a"), F.col("s")).alias("p")).collect():
        assert r.p == plain_permutation(r.a, r.s)


def test_versions_and_graph(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "dependency int, dependent int")
    assert {(r.node, r.depth) for r in versions.downstream(edges, spark.createDataFrame([(1,)], "node int")).collect()} == {(2, 1), (3, 2), (1, 3), (4, 3)}
    proposed = spark.createDataFrame([(1, 4), (4, 1), (9, 9)], "dependent int, dependency int")
    assert {(r.dependent, r.cycle) for r in versions.would_cycle(edges.where("dependency <> 3 or dependent <> 1"), proposed).collect()} == {(1, True), (4, False), (9, True)}
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, n int")
    new = spark.createDataFrame([(2, "x", 5), (2, "y", 6), (3, None, 1)], "k int, v string, n int")
    assert {tuple(r) for r in versions.upsert(base, new, ["k"], "n", ["v"]).collect()} == {(1, "a", 1), (2, "y", 1), (3, None, 1)}


def test_render(spark):
    cols = "unit_id string, text string, voice_id string, speed double, ordinal int, speaker string, span_start int, span_end int, mode string, instruction string"
    rows = spark.createDataFrame([("u1", "abc", "v", 1.0, 0, "s", 0, 3, "PLAIN", None), ("", " ", "v", 9.0, -1, None, 3, 0, "X", None)], cols)
    got = [r[0] for r in rows.select(render.unit_violations()).collect()]
    assert got[0] == [] and {"UNIT_ID_MISSING", "TEXT_BLANK", "SPEED_RANGE", "ORDINAL_NEGATIVE", "SPEAKER_MISSING", "SPAN_INVERTED", "MODE_UNKNOWN"} <= set(got[1])
    i = spark.range(1).select(render.compile_instruction({"emotion": F.lit("SAD"), "pace": F.lit("SLOW"), "volume": F.lit("ODD")}, F.lit(0.8)).alias("i")).first().i
    assert (i.instruction, i.unknown_keys, i.mode) == ("very sad, slowly", ["volume=ODD"], "INSTRUCTED")
    jobs = spark.createDataFrame([(1, 2, "RUNNING", None), (2, 4, "RUNNING", None)], "job_id int, attempts int, state string, not_before long")
    assert {(r.job_id, r.state, r.not_before) for r in render.fail_jobs(jobs, F.lit(0)).collect()} == {(1, "RETRY", 4000), (2, "FAILED", None)}
    units = spark.createDataFrame([("a", ["b"]), ("z", None)], "wanted string, fallbacks array<string>")
    assert [r.route for r in render.speech_route(units, spark.createDataFrame([("b", True), ("a", False)], "engine string, available boolean")).orderBy("wanted").collect()] == ["b", "unavailable"]


def test_scores_and_generators(spark):
    rows = spark.createDataFrame([("A", "A", "C"), ("A", None, "C"), (None, "B", "C")], "gold_owner string, pred_owner string, d string").withColumns({"gold_ref": F.lit("r"), "pred_ref": F.lit("r")})
    r = evaluation.binding_scores(rows, ["d"]).first()
    assert (r.owner_accuracy, r.ref_accuracy, r.joint_accuracy) == (0.5, 1.0, 0.5)
    roster = generators.rosters(spark.createDataFrame([(f"n{i}",) for i in range(8)], "name string"), [2, 3], 7, 2)
    samples = generators.fill_templates(spark.createDataFrame([("t", "{S} met {O}.")], "template_id string, template string"), roster, 7)
    got = samples.collect()
    assert len(got) == 2 * 2 + 2 * 3 and len({r.sample_id for r in got}) == len(got) and all(r.gold in r.candidates and r.text.startswith(r.gold) and not r.text.endswith(f"met {r.gold}.") for r in got)
    assert generators.dedup_two_levels(samples).count() == 1
