"""Structured decisions: JSON cut out of noisy text, repaired, validated, routed, encoded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The decision protocol's enumerations and safe values.
ENUMS = {
    "emotion": ["NEUTRAL", "TIRED", "SAD", "ANGRY", "CALM", "JOYFUL", "FEARFUL", "SURPRISED", "GENTLE", "COLD", "EXCITED", "SARCASTIC", "RESIGNED"],
    "pace": ["SLOW", "NORMAL", "FAST"],
    "volume": ["QUIET", "NORMAL", "LOUD"],
    "tone": ["NEUTRAL", "WEARY", "GENTLE", "COLD", "SERIOUS", "WARM", "SARCASTIC"],
    "voice_event": ["NORMAL", "WHISPER", "CRY", "LAUGH", "SHOUT", "SIGH", "MUMBLE"],
}
SAFE = {"emotion": "NEUTRAL", "pace": "NORMAL", "volume": "NORMAL", "tone": "NEUTRAL", "voice_event": "NORMAL"}
SAFE_INTENSITY = 0.5
SCHEMA = "segment_id string, speaker string, type string, emotion string, emotion_intensity string, delivery struct<pace:string,volume:string,tone:string>, `delivery.pace` string, `delivery.volume` string, `delivery.tone` string, voice_event string, evidence array<string>"


def extract_object(text: Column) -> Column:
    """The first balanced JSON object of a text, braces inside strings aside; what follows an opening brace if it never closes; null without one."""
    body = F.when(F.contains(text, F.lit("{")), F.substring(text, F.instr(text, "{"), F.length(text)))
    # only braces, quotes and escapes matter: cut the text at them and scan the pieces
    marks = F.regexp_extract_all(body, F.lit(r'(\\.|["{}]|[^\\"{}]+|\\)'), F.lit(1))
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(None).cast("int").alias("end"))

    def step(a: Column, m: Column) -> Column:
        depth = a["depth"] + F.when(~a["quoted"] & (m == "{"), 1).when(~a["quoted"] & (m == "}"), -1).otherwise(0)
        at = a["at"] + F.length(m)
        closed = ~a["quoted"] & (m == "}") & (depth == 0)
        return F.struct(at.alias("at"), depth.alias("depth"), F.when(m == '"', ~a["quoted"]).otherwise(a["quoted"]).alias("quoted"), F.coalesce(a["end"], F.when(closed, at)).alias("end"))

    end = F.aggregate(marks, zero, step, lambda a: F.coalesce(a["end"], a["at"]))
    return F.when(body.isNotNull(), F.left(body, end))


def repair_json(text: Column) -> tuple[Column, Column]:
    """(repaired object text, names of the repairs): fences and noise off, trailing commas out, bare tokens quoted."""
    raw = F.trim(text)
    found = extract_object(raw)
    no_comma = F.regexp_replace(found, r",\s*([}\]])", "$1")
    quoted = F.regexp_replace(no_comma, r":\s*(?!(?:true|false|null)\s*[,}\]])([A-Za-z_][A-Za-z0-9_]*)\s*([,}\]])", ': "$1"$2')
    fixes = F.array_compact(
        F.array(
            F.when((found != raw) & F.contains(raw, F.lit("```")), "CODE_FENCE_STRIPPED"), F.when(found != raw, "JSON_OBJECT_EXTRACTED"), F.when(no_comma != found, "TRAILING_COMMA"), F.when(quoted != no_comma, "BARE_TOKEN_QUOTED"),
        )
    )
    return quoted, fixes


def normalize(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """``rows`` with ``d`` (the decision's fields, enumerations in their own case or UNRECOGNIZED), ``fixes`` and ``parse_failed``."""
    text, fixes = repair_json(F.col(raw))
    rows = rows.withColumn("__json", text).withColumn("fixes", F.coalesce(fixes, F.array().cast("array<string>"))).withColumn("__o", F.from_json("__json", SCHEMA, {"mode": "PERMISSIVE"}))
    ok = F.col("__json").isNotNull() & F.try_parse_json(F.col("__json")).isNotNull()
    o = F.col("__o")
    flat = {k: o[f"delivery.{k}"] for k in ("pace", "volume", "tone")}
    any_flat = o["delivery"].isNull() & F.coalesce(*(c.isNotNull() | F.lit(None).cast("boolean") for c in flat.values()), F.lit(False))
    value = {"emotion": o["emotion"], "voice_event": o["voice_event"], **{k: F.coalesce(o["delivery"][k], F.when(o["delivery"].isNull(), flat[k])) for k in flat}}
    enum = lambda k: F.when(F.upper(F.trim(value[k])).isin(*ENUMS[k]), F.upper(F.trim(value[k]))).otherwise("UNRECOGNIZED")
    recased = F.coalesce(*(F.when(F.upper(F.trim(c)).isin(*ENUMS[k]) & ~F.trim(c).isin(*ENUMS[k]), F.lit(True)) for k, c in value.items()), F.lit(False))
    kind = F.upper(F.trim(o["type"]))
    cited = F.transform(F.coalesce(o["evidence"], F.array().cast("array<string>")), lambda e: F.coalesce(F.nullif(F.regexp_extract(e, r"^\s*(E\d+)\b", 1), F.lit("")), e))
    trailing = F.exists(F.coalesce(o["evidence"], F.array().cast("array<string>")), lambda e: e.rlike(r"^\s*E\d+\b.*\S") & ~e.rlike(r"^E\d+$"))
    d = F.struct(
        F.coalesce(o["segment_id"], F.lit("")).alias("segment_id"), F.coalesce(o["speaker"], F.lit("")).alias("speaker"), F.when(kind.isin("NARRATION", "DIALOGUE"), kind).otherwise("UNRECOGNIZED").alias("type"),
        *(enum(k).alias(k) for k in ENUMS), F.trim(o["emotion_intensity"]).try_cast("double").alias("intensity"), cited.alias("evidence"),
    )
    more = F.array_compact(F.array(F.when(any_flat, "FLAT_DELIVERY_KEY"), F.when(recased, "ENUM_CASE"), F.when(trailing, "EVIDENCE_TRAILING_TEXT")))
    return rows.withColumn("parse_failed", ~ok).withColumn("d", F.when(ok, d)).withColumn("fixes", F.when(ok, F.concat("fixes", more)).otherwise(F.col("fixes"))).drop("__json", "__o")


def validate(rows: DataFrame, token: str = "token", candidates: str = "candidates", provided: str = "provided") -> DataFrame:
    """``rows`` with hard and soft failures, outcome and the decision with unsafe fields made safe.

    Hard failures reject; soft ones downgrade; an UNKNOWN speaker is verified; the rest is accepted.
    """
    d = F.col("d")
    ref = d["speaker"].rlike(r"^C\d+$")
    special = d["speaker"].isin("NARRATOR", "UNKNOWN")
    agrees = ((d["speaker"] == "NARRATOR") & (d["type"] == "NARRATION")) | ((ref | (d["speaker"] == "UNKNOWN")) & (d["type"] == "DIALOGUE"))
    hard = F.when(d.isNull(), F.array(F.lit("JSON_PARSE_FAILED"))).otherwise(F.array_compact(F.array(
        F.when(F.trim(d["segment_id"]) == "", "SEGMENT_ID_MISSING").when(d["segment_id"] != F.col(token), "SEGMENT_ID_MISMATCH"),
        F.when(F.trim(d["speaker"]) == "", "SPEAKER_MISSING").when(ref & ~F.array_contains(candidates, d["speaker"]), "SPEAKER_ID_MISSING").when(~ref & ~special, "SPEAKER_ID_INVALID"),
        F.when((F.trim(d["speaker"]) != "") & ~agrees, "SPEAKER_TYPE_CONFLICT"),
    )))
    in_range = F.coalesce(d["intensity"].between(0, 1), F.lit(False)) & ~F.isnan(F.coalesce(d["intensity"], F.lit(0.0)))
    form = lambda e: e.rlike(r"^E\d+$")
    soft = F.when(d.isNull(), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(
        F.when(d["emotion"] == "UNRECOGNIZED", "EMOTION_INVALID"), F.when(~in_range, "EMOTION_INTENSITY_RANGE"), F.when(d["pace"] == "UNRECOGNIZED", "DELIVERY_PACE_INVALID"), F.when(d["volume"] == "UNRECOGNIZED", "DELIVERY_VOLUME_INVALID"), F.when(d["tone"] == "UNRECOGNIZED", "DELIVERY_TONE_INVALID"),
        F.when(d["voice_event"] == "UNRECOGNIZED", "VOICE_EVENT_INVALID"), F.when(F.exists(d["evidence"], lambda e: ~form(e)), "EVIDENCE_ID_INVALID"), F.when(F.exists(d["evidence"], lambda e: form(e) & ~F.array_contains(provided, e)), "EVIDENCE_ID_MISSING"),
    )))
    rows = rows.withColumn("hard", hard).withColumn("soft", soft)
    outcome = F.when(F.size("hard") > 0, "REJECT").when(F.size("soft") > 0, "DOWNGRADE").when(d["speaker"] == "UNKNOWN", "VERIFY").otherwise("ACCEPTED_ALL")
    safe = lambda k: F.when(d[k] == "UNRECOGNIZED", F.lit(SAFE[k])).otherwise(d[k]).alias(k)
    cleaned = F.struct(d["segment_id"].alias("segment_id"), d["speaker"].alias("speaker"), d["type"].alias("type"), *(safe(k) for k in ENUMS), F.when(in_range, d["intensity"]).otherwise(SAFE_INTENSITY).alias("intensity"), F.filter(d["evidence"], lambda e: form(e) & F.array_contains(provided, e)).alias("evidence"))
    return rows.withColumn("outcome", outcome).withColumn("decision", F.when(F.size("hard") == 0, cleaned))


def protocol_verdict(raw: Column, allowed: Column, candidates: Column) -> tuple[Column, Column]:
    """(answer, verdict) of a one-field answer: STRICT if the text is the object, REPAIRABLE if it had to be cut out, OUT_OF_CANDIDATE, FAIL."""
    found = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    answer = F.get_json_object(F.nullif(found, F.lit("")), "$.answer")
    legal = F.array_contains(allowed, answer) | F.coalesce(F.array_contains(candidates, answer), F.lit(False))
    verdict = F.when((found == "") | answer.isNull(), "FAIL").when(~legal, "OUT_OF_CANDIDATE").when(F.trim(raw) == found, "STRICT").otherwise("REPAIRABLE")
    return answer, verdict


def validate_binding(owner: Column, reference: Column, confidence: Column, candidates: Column, kind: Column) -> Column:
    """All that is wrong with a binding, in a fixed order."""
    known = lambda c: F.array_contains(candidates, c) | (c == "UNKNOWN")
    return F.array_compact(F.array(
        F.when(owner.isNull() | (owner == ""), "OWNER_MISSING").when(~known(owner), "OWNER_NOT_CANDIDATE"), F.when(reference.isNotNull() & ~known(reference), "REFERENCE_NOT_CANDIDATE"),
        F.when((kind == "NONE") & (owner != "UNKNOWN"), "NONE_WITH_OWNER"), F.when(confidence.isNull() | ~confidence.between(0, 1), "CONFIDENCE_RANGE"),
    ))


def shortcut(kind: Column, candidates: Column) -> Column:
    """Decisions that need no model: narration is the narrator's, without candidates the speaker is unknown; else null."""
    return F.when(kind == "NARRATION", "NARRATOR").when(F.coalesce(F.size(candidates), F.lit(0)) == 0, "UNKNOWN")


def speaker_ref(speaker: Column, local_map: Column) -> Column:
    """A stable token from a local one: ``CHARACTER:ID``, ``NARRATOR`` or ``UNKNOWN``; null for a local id that isn't in the map."""
    return F.when(speaker.isin("NARRATOR", "UNKNOWN"), speaker).otherwise(F.concat(F.lit("CHARACTER:"), F.try_element_at(local_map, speaker).cast("string")))


def decode_ref(token: Column) -> Column:
    """struct<kind, id> of a stable token; nulls for anything else, local ids too."""
    kind = F.when(token.isin("NARRATOR", "UNKNOWN"), token).when(token.rlike(r"^CHARACTER:\d+$"), "CHARACTER")
    return F.struct(kind.alias("kind"), F.nullif(F.regexp_extract(token, r"^CHARACTER:(\d+)$", 1), F.lit("")).try_cast("long").alias("id"))


def agreement(rule: Column, student: Column, teacher: Column) -> Column:
    """How three answers agree; the first test that holds decides."""
    return (
        F.when(teacher.isNull(), "NO_TEACHER").when((rule == teacher) & (student == teacher), "ALL_AGREE").when(rule == teacher, "RULE_TEACHER").when(student == teacher, "STUDENT_TEACHER")
        .when(rule == student, "RULE_STUDENT").otherwise("ALL_DIFFER")
    )


def route(pattern: Column, valid: Column, unstable: Column) -> Column:
    """Where a labelled sample goes: quarantine, arbitration, audit or silver."""
    return F.when(~valid, "QUARANTINE").when(unstable | pattern.isin("ALL_DIFFER"), "ARBITRATION").when(pattern.isin("RULE_STUDENT", "NO_TEACHER"), "AUDIT").otherwise("SILVER")


def encode_lines(rows: DataFrame, columns: list[str], version: int = 2) -> DataFrame:
    """JSON lines with their schema version first."""
    return rows.select(F.to_json(F.struct(F.lit(version).alias("schemaVersion"), *columns)).alias("value"))


def decode_lines(lines: DataFrame, schema: str, version: int = 2) -> DataFrame:
    """Rows of JSON lines of the given version; damaged ones are left out, and older ones are what ``legacy_lines`` reads."""
    parsed = lines.select(F.from_json("value", f"schemaVersion int, {schema}", {"mode": "PERMISSIVE"}).alias("r"))
    return parsed.where(F.col("r.schemaVersion") == version).select("r.*").drop("schemaVersion")


def legacy_lines(lines: DataFrame, version: int = 2) -> DataFrame:
    """segment_id, text, raw_speaker, schema_version, speaker_resolvable (never) of JSON lines of older versions, or of none, which is the first.

    Their speakers are local ids of a run that is gone, so they are shown, never resolved.
    """
    parsed = lines.where(F.try_parse_json("value").isNotNull()).select(F.from_json("value", "schemaVersion int, segment_id long, text string, speaker string", {"mode": "PERMISSIVE"}).alias("r"))
    n = F.coalesce("r.schemaVersion", F.lit(1))
    return parsed.where(n < version).select(F.coalesce("r.segment_id", F.lit(0).cast("long")).alias("segment_id"), F.coalesce("r.text", F.lit("")).alias("text"), F.coalesce("r.speaker", F.lit("")).alias("raw_speaker"), n.alias("schema_version"), F.lit(False).alias("speaker_resolvable"))


def runner_stats(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Outcome counts, coverage and accepted share of each run."""
    n = F.count("*")
    return rows.groupBy(*keys).agg(n.alias("n"), *(F.count_if(F.col("outcome") == o).alias(f"n_{o.lower()}") for o in ("ACCEPTED_ALL", "DOWNGRADE", "VERIFY", "REJECT")), (F.count_if(F.col("outcome") != "REJECT") / n).alias("coverage"))


def failure_histogram(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode(F.concat("hard", "soft")).alias("code")).groupBy("code").agg(F.count("*").alias("n"))
