"""Queries on what holds where: decisions that pass, records that an event makes invalid, chapters of lines, states at a position, speakers that a gap takes."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.lexicon import LATIN
from folio.operators import decisions, generators, identity, layout, paragraphs, state, versions
from folio.operators.chapters import winners
from folio.plans.base import LINES, query, table
from folio.plans.structure import CANDIDATE_SQL, PROFILE_SQL, candidate_rows, document_lines


@query(
    r"""WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS t FROM conversations),
    x AS (SELECT *, conv_id || '-' || (row_number() OVER w - 1) AS token, coalesce(max(role = 'user') OVER b, false) AS has1, coalesce(max(role = 'assistant') OVER b, false) AS has2, coalesce(length(lag(t) OVER w) > 300, false) AS shown, len(string_split(t, chr(10))) AS n_lines
        FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn), b AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    d AS (SELECT *, CASE WHEN t = '' THEN '' ELSE conv_id || '-' || turn END AS segment, CASE WHEN NOT contains(t, ',') THEN 'UNKNOWN' WHEN role = 'user' THEN 'C1' WHEN role = 'assistant' THEN 'C2' WHEN role = 'system' THEN 'NARRATOR' ELSE coalesce(role, '') END AS speaker,
        CASE WHEN role = 'system' OR n_lines > 6 THEN 'NARRATION' ELSE 'DIALOGUE' END AS kind, length(t) / 1000 AS level FROM x),
    f AS (SELECT *, concat_ws(',', CASE WHEN segment = '' THEN 'SEGMENT_ID_MISSING' WHEN segment <> token THEN 'SEGMENT_ID_MISMATCH' END,
        CASE WHEN speaker = '' THEN 'SPEAKER_MISSING' WHEN speaker = 'C1' AND NOT has1 OR speaker = 'C2' AND NOT has2 THEN 'SPEAKER_ID_MISSING' WHEN speaker NOT IN ('C1', 'C2', 'NARRATOR', 'UNKNOWN') THEN 'SPEAKER_ID_INVALID' END,
        CASE WHEN speaker <> '' AND NOT (speaker = 'NARRATOR' AND kind = 'NARRATION' OR speaker IN ('C1', 'C2', 'UNKNOWN') AND kind = 'DIALOGUE') THEN 'SPEAKER_TYPE_CONFLICT' END) AS hard,
        concat_ws(',', CASE WHEN NOT regexp_matches(t, ' (is|et|y) ') THEN 'EMOTION_INVALID' END, CASE WHEN level > 1 THEN 'EMOTION_INTENSITY_RANGE' END, CASE WHEN n_lines > 6 THEN 'DELIVERY_PACE_INVALID' END,
        CASE WHEN starts_with(t, 'A') THEN 'EVIDENCE_ID_INVALID' END, CASE WHEN turn > 0 AND NOT shown THEN 'EVIDENCE_ID_MISSING' END) AS soft FROM d)
    SELECT conv_id, turn, hard, soft, CASE WHEN hard <> '' THEN 'REJECT' WHEN soft <> '' THEN 'DOWNGRADE' WHEN speaker = 'UNKNOWN' THEN 'VERIFY' ELSE 'ACCEPTED_ALL' END AS outcome, CASE WHEN hard = '' THEN CASE WHEN contains(t, ' is ') THEN 'CALM' WHEN contains(t, ' et ') THEN 'GENTLE' WHEN contains(t, ' y ') THEN 'JOYFUL' ELSE 'NEUTRAL' END END AS emotion,
        CASE WHEN hard = '' THEN CASE WHEN n_lines = 1 THEN 'SLOW' WHEN n_lines IN (5, 6) THEN 'FAST' ELSE 'NORMAL' END END AS pace, CASE WHEN hard = '' THEN CASE WHEN level <= 1 THEN level ELSE 0.5 END END::DOUBLE AS intensity, CASE WHEN hard = '' THEN (turn > 0 AND shown)::INT END AS n_evidence FROM f"""
)
def validated_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn as a decision on its own speaker: who spoke before are the candidates, the turn before is evidence if it is long, and length, lines and small words give the rest."""
    by_turn = W.partitionBy("conv_id").orderBy("turn")
    before = by_turn.rowsBetween(W.unboundedPreceding, -1)
    t, said = F.col("t"), lambda role: F.max(F.col("role") == role).over(before)
    last = F.concat(F.lit("E"), F.col("turn") - 1)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("t")).select(
        "*", F.concat_ws("-", "conv_id", F.row_number().over(by_turn) - 1).alias("token"), F.array_compact(F.array(F.when(said("user"), "C1"), F.when(said("assistant"), "C2"))).alias("candidates"),
        F.array_compact(F.array(F.when(F.length(F.lag("t").over(by_turn)) > 300, last))).alias("provided"), F.size(F.split("t", "\n")).alias("n_lines"),
    )
    word = F.when(F.contains(t, F.lit(" is ")), "CALM").when(F.contains(t, F.lit(" et ")), "GENTLE").when(F.contains(t, F.lit(" y ")), "JOYFUL").otherwise("UNRECOGNIZED")
    d = F.struct(
        F.when(t == "", "").otherwise(F.concat_ws("-", "conv_id", "turn")).alias("segment_id"),
        F.when(~F.contains(t, F.lit(",")), "UNKNOWN").when(F.col("role") == "user", "C1").when(F.col("role") == "assistant", "C2").when(F.col("role") == "system", "NARRATOR").otherwise(F.coalesce("role", F.lit(""))).alias("speaker"),
        F.when((F.col("role") == "system") | (F.col("n_lines") > 6), "NARRATION").otherwise("DIALOGUE").alias("type"), word.alias("emotion"),
        F.when(F.col("n_lines") == 1, "SLOW").when(F.col("n_lines") <= 4, "NORMAL").when(F.col("n_lines") <= 6, "FAST").otherwise("UNRECOGNIZED").alias("pace"),
        F.lit("NORMAL").alias("volume"), F.lit("NEUTRAL").alias("tone"), F.lit("NORMAL").alias("voice_event"), (F.length(t) / 1000).alias("intensity"),
        F.array_compact(F.array(F.when(F.col("turn") > 0, last), F.when(F.startswith(t, F.lit("A")), "A"))).alias("evidence"),
    )
    got = decisions.validate(rows.withColumn("d", d))
    return got.select("conv_id", "turn", F.array_join("hard", ",").alias("hard"), F.array_join("soft", ",").alias("soft"), "outcome", "decision.emotion", "decision.pace", "decision.intensity", F.when(F.col("decision").isNotNull(), F.size("decision.evidence")).alias("n_evidence"))


@query(
    """WITH RECURSIVE e AS (SELECT 'r' || n_regionkey AS up, 'n' || n_nationkey AS down FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders),
    ev AS (SELECT 'c' || user_id AS id, CASE WHEN value >= 10 THEN 'BOOK' ELSE 'CHAPTER' END AS scope FROM events WHERE event_type = 'error' UNION ALL SELECT 'n' || s_nationkey, CASE WHEN s_acctbal < -900 THEN 'BOOK' ELSE 'CHAPTER' END FROM supplier WHERE s_acctbal < -600),
    hit(id) AS (SELECT id FROM ev WHERE scope = 'BOOK' UNION SELECT down FROM e JOIN hit ON up = id), named AS (SELECT down AS revision_id FROM e UNION SELECT 'r' || r_regionkey FROM region)
    SELECT revision_id, revision_id IN (SELECT down FROM e JOIN hit ON up = id UNION SELECT id FROM ev) AS invalid FROM named"""
)
def invalidated_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which regions, nations, customers, suppliers and orders are invalid: all below a customer's dear error or a nation's deep debt, and only the record itself for a slight one."""
    t = lambda name: table(spark, sf_dir, name)
    node = lambda letter, key: F.concat(F.lit(letter), F.col(key).cast("string"))
    links = [("nation", "r", "n_regionkey", "n", "n_nationkey"), ("customer", "n", "c_nationkey", "c", "c_custkey"), ("supplier", "n", "s_nationkey", "s", "s_suppkey"), ("orders", "c", "o_custkey", "o", "o_orderkey")]
    edges = None
    for name, a, up, b, down in links:
        part = t(name).select(node(a, up).alias("dependency"), node(b, down).alias("dependent"))
        edges = part if edges is None else edges.union(part)
    scope = lambda whole: F.when(whole, "BOOK").otherwise("CHAPTER").alias("scope")
    events = t("events").where("event_type = 'error'").select(node("c", "user_id").alias("revision_id"), scope(F.col("value") >= 10))
    events = events.union(t("supplier").where("s_acctbal < -600").select(node("n", "s_nationkey"), scope(F.col("s_acctbal") < -900)))
    revisions = edges.select(F.col("dependent").alias("revision_id")).union(t("region").select(node("r", "r_regionkey"))).distinct()
    return versions.invalidate(edges, events, revisions)


@query(
    f"""WITH {LINES}, live AS (SELECT doc_id, line_no, regexp_extract_all(text, '[,.]') AS a FROM lines WHERE NOT is_blank), m AS (SELECT doc_id, line_no, unnest(a) AS m, generate_subscripts(a, 1) AS k FROM live), s AS (SELECT *, sum(CASE m WHEN ',' THEN 1 ELSE -1 END) OVER (PARTITION BY doc_id ORDER BY line_no, k) AS s FROM m),
    p AS (SELECT doc_id, line_no, s - least(0, min(s) OVER (PARTITION BY doc_id ORDER BY line_no, k)) AS depth, k FROM s), e AS (SELECT doc_id, line_no, arg_max(depth, k) AS depth FROM p GROUP BY ALL)
    SELECT doc_id, round(count(*) FILTER (before > 0) / count(*), 6) AS quote_cross FROM (SELECT l.doc_id, last_value(e.depth IGNORE NULLS) OVER (PARTITION BY l.doc_id ORDER BY l.line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM live l LEFT JOIN e ON l.doc_id = e.doc_id AND l.line_no = e.line_no) GROUP BY doc_id"""
)
def open_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each document's lines that begin in what an earlier comma opened and no full stop has closed, as quotations would."""
    rows = layout.cross_line_quotes(document_lines(spark, sf_dir), ["doc_id"], replace(LATIN, quotes=((",", "."),)))
    return rows.withColumn("quote_cross", F.round("quote_cross", 6))


def starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winners(candidate_rows(spark, sf_dir)).select("doc_id", F.col("line_no").alias("start_line"))


#: Lines with the start of the chapter that they are in; chapters start where a heading rule wins.
IN_CHAPTER = f"{CANDIDATE_SQL}, cl AS (SELECT * FROM (SELECT l.*, max(w.line_no) OVER (PARTITION BY l.doc_id ORDER BY l.line_no) AS start_line FROM lines l LEFT JOIN win w ON w.doc_id = l.doc_id AND w.line_no = l.line_no))"
CHAPTER_PROFILE = PROFILE_SQL.removeprefix(f"WITH {LINES}").replace("FROM lines)", "FROM kl)")


@query(
    f"""{IN_CHAPTER}, kl AS (SELECT {{'d': doc_id, 's': start_line}} AS doc_id, line_no, text, char_count, is_blank FROM cl WHERE start_line IS NOT NULL){CHAPTER_PROFILE}
    SELECT doc_id.d AS doc_id, doc_id.s AS start_line, n::BIGINT AS n, median_len::DOUBLE AS median_len, round(std_len, 5) AS std_len, round(near_mode, 6) AS near_mode, round(terminal, 6) AS terminal, profile_type FROM c"""
)
def chapter_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout figures and class of each chapter's lines."""
    rows = layout.chapter_profiles(document_lines(spark, sf_dir), starts(spark, sf_dir))
    return rows.select("doc_id", "start_line", "n", "median_len", F.round("std_len", 5).alias("std_len"), F.round("near_mode", 6).alias("near_mode"), F.round("terminal", 6).alias("terminal"), "profile_type")


@query(
    f"""{IN_CHAPTER}, ch AS (SELECT doc_id, start_line, max(line_no) FILTER (NOT is_blank) AS end_line FROM cl WHERE start_line IS NOT NULL GROUP BY ALL)
    SELECT l.doc_id, l.line_no, ch.start_line AS chapter_line FROM lines l LEFT JOIN ch ON ch.doc_id = l.doc_id AND l.line_no BETWEEN ch.start_line AND ch.end_line"""
)
def line_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line's chapter, from a heading to the last line with text before the next one; null before the first and between chapters."""
    rows = document_lines(spark, sf_dir).select("doc_id", "line_no", "is_blank")
    here = starts(spark, sf_dir).select("doc_id", "start_line", F.col("start_line").alias("line_no"))
    w = W.partitionBy("doc_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    held = rows.join(here, ["doc_id", "line_no"], "left").withColumn("start_line", F.last("start_line", ignorenulls=True).over(w))
    ends = held.where("start_line is not null and not is_blank").groupBy("doc_id", "start_line").agg(F.max("line_no").alias("end_line")).withColumn("chapter_id", F.col("start_line"))
    return paragraphs.chapter_of(rows.select("doc_id", "line_no"), ends, line="line_no").withColumnRenamed("chapter_id", "chapter_line")


@query(
    """WITH e AS (SELECT *, epoch_us(ts) AS pos FROM events), s AS (SELECT event_id, user_id AS entity, pos FROM e WHERE event_type IN ('view', 'click')), ph AS (SELECT user_id, pos, props AS phase FROM e WHERE event_type = 'signup'),
    ov AS (SELECT user_id, pos AS s, pos + (value * 3600000000)::BIGINT AS e, event_type || event_id AS v FROM e WHERE event_type = 'purchase'), bo AS (SELECT user_id, pos AS s, lead(pos) OVER (PARTITION BY user_id ORDER BY pos) AS e, 'b' || event_id AS v FROM e WHERE event_type = 'error')
    SELECT event_id, arg_max(ph.phase, ph.pos) AS phase, (SELECT arg_max(v, ov.s) FROM ov WHERE ov.user_id = s.entity AND ov.s <= s.pos AND s.pos < ov.e) AS descriptor, (SELECT arg_max(v, bo.s) FROM bo WHERE bo.user_id = s.entity AND bo.s <= s.pos AND (bo.e IS NULL OR s.pos <= bo.e)) AS body, any_value(c.c_nationkey) AS cluster
    FROM s LEFT JOIN ph ON ph.user_id = s.entity AND ph.pos <= s.pos LEFT JOIN customer c ON c.c_custkey = s.entity GROUP BY event_id, s.entity, s.pos"""
)
def narration_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views and clicks with what holds of their user: the last signup, the latest purchase whose hours haven't run out, the error in force, and the nation."""
    e = table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    of = lambda *kinds: e.where(F.col("event_type").isin(*kinds))
    segments = of("view", "click").select("event_id", F.col("user_id").alias("entity"), F.col("at").alias("position"))
    phases = of("signup").select(F.col("user_id").alias("entity"), F.col("at").alias("start_at"), F.col("props").alias("phase"))
    timed = of("purchase").select(F.col("user_id").alias("entity"), F.col("at").alias("start_at"), (F.col("at") + F.round(F.col("value") * 3600000000).cast("long")).alias("end_at"), F.concat("event_type", "event_id").alias("descriptor"))
    until = F.lead("at").over(W.partitionBy("user_id").orderBy("at"))
    bodies = of("error").select(F.col("user_id").alias("entity"), F.col("at").alias("start_at"), until.alias("end_at"), F.concat(F.lit("b"), "event_id").alias("body"))
    clusters = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"), F.col("c_nationkey").alias("cluster"))
    rows = identity.narration_ir(segments, phases, timed, bodies, clusters)
    return rows.select("event_id", F.col("asof_phase").alias("phase"), F.col("held_descriptor").alias("descriptor"), F.col("held_body").alias("body"), "cluster")


@query(
    """WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS t, regexp_extract(lag(coalesce(text, ''), 1, '') OVER (PARTITION BY conv_id ORDER BY turn), '([A-Za-z]+)[^A-Za-z]*$', 1) AS span FROM conversations),
    n AS (SELECT *, CASE WHEN span = '' THEN 0 ELSE (length(t) - length(replace(t, span, ''))) // length(span) END AS n FROM c)
    SELECT conv_id, turn, left(sha256(conv_id || '|' || turn || '|' || span), 16) AS event_uid, CASE WHEN n > 0 THEN (instr(t, span) - 1)::INT END AS span_start, CASE WHEN n > 0 THEN (instr(t, span) - 1 + length(span))::INT END AS span_end,
        concat_ws(',', CASE WHEN n = 0 THEN 'SPAN_ABSENT' WHEN n > 1 THEN 'SPAN_AMBIGUOUS' END, CASE WHEN role = 'system' THEN 'KIND_UNKNOWN' END) AS faults FROM n"""
)
def span_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity, place and faults of the last word of the turn before, as an event's span in each turn."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("t"))
    before = F.lag("t", 1, "").over(W.partitionBy("conv_id").orderBy("turn"))
    rows = rows.withColumn("span", F.regexp_extract(before, r"([A-Za-z]+)[^A-Za-z]*$", 1))
    kind = F.when(F.col("role") == "user", "VOICE_OVERRIDE").when(F.col("role") == "system", "SYSTEM").otherwise("NONE")
    ir = generators.voice_event_ir(F.col("conv_id"), F.col("turn"), F.col("span"), F.col("t"), kind)
    return rows.select("conv_id", "turn", ir.alias("ir")).select("conv_id", "turn", F.col("ir.event_id").alias("event_uid"), F.col("ir.start").alias("span_start"), F.col("ir.end").alias("span_end"), F.array_join("ir.faults", ",").alias("faults"))


@query(
    r"""WITH RECURSIVE c AS (SELECT conv_id, turn, CASE WHEN NOT starts_with(coalesce(text, ''), 'E') AND turn % 4 = 1 THEN role END AS speaker, role = 'system' OR coalesce(length(text), 0) < 150 AS reset, list_filter(regexp_extract_all(coalesce(text, ''), '[A-Z][a-z]*'), lambda x: x <> '') AS mentions,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
    m AS (SELECT c.conv_id, c.i, p.w, count(*) AS n FROM c JOIN (SELECT conv_id, i, unnest(mentions) AS w FROM c) p ON p.conv_id = c.conv_id AND p.i BETWEEN c.i - 5 AND c.i - 1 GROUP BY ALL), k AS (SELECT conv_id, i, w FROM m QUALIFY row_number() OVER (PARTITION BY conv_id, i ORDER BY n DESC, w) = 1),
    x AS (SELECT c.*, k.w AS mode FROM c LEFT JOIN k ON k.conv_id = c.conv_id AND k.i = c.i),
    walk AS (SELECT conv_id, i, turn, coalesce(speaker, mode) AS got, CASE WHEN speaker IS NOT NULL THEN 'GIVEN' WHEN mode IS NOT NULL THEN 'MODE' ELSE 'NONE' END AS how FROM x WHERE i = 1 UNION ALL
        SELECT x.conv_id, x.i, x.turn, coalesce(x.speaker, CASE WHEN NOT x.reset THEN w.got END, x.mode), CASE WHEN x.speaker IS NOT NULL THEN 'GIVEN' WHEN NOT x.reset AND w.got IS NOT NULL THEN 'LAST' WHEN x.mode IS NOT NULL THEN 'MODE' ELSE 'NONE' END FROM walk w JOIN x ON x.conv_id = w.conv_id AND x.i = w.i + 1)
    SELECT conv_id, turn, got AS speaker, how FROM walk"""
)
def recovered_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speakers of turns where only some are given: the last one until a short turn or a system turn resets, else the word with a capital that the five turns before have most."""
    t = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.when(~F.startswith(t, F.lit("E")) & (F.col("turn") % 4 == 1), F.col("role")).alias("speaker"), ((F.col("role") == "system") | (F.length(t) < 150)).alias("reset"), F.regexp_extract_all(t, F.lit("([A-Z][a-z]*)"), F.lit(1)).alias("mentions")
    )
    return state.recover_speakers(rows, ["conv_id"], "turn")
