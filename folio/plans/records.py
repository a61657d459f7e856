"""Queries on records that the tables stand for: render jobs, revisions, decisions, identities, runs and samples. Most take an order as one record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import text as scalars
from folio.functions.numerals import normalize_digits
from folio.operators import decisions, evaluation, generators, identity, integrity, render, sampling, state, versions
from folio.plans.base import query, table



def order_key() -> Column:
    return F.col("o_orderkey")


def pick(key: Column, *values) -> Column:
    """One of the values by the key's remainder."""
    return F.element_at(F.array(*(v if isinstance(v, Column) else F.lit(v) for v in values)), (key % len(values) + 1).cast("int"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")


@query(
    """WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS t FROM conversations), n AS (SELECT *, (length(t) - length(replace(t, 'the', ''))) // 3 AS n FROM c)
    SELECT conv_id, turn, turn::VARCHAR || (conv_id % 100)::VARCHAR AS digits, len(list_filter(list_transform(regexp_extract_all(t, '[^.!?]+[.!?]*'), lambda x: trim(x, ' ')), lambda x: x <> ''))::INT AS n_sentences, contains(t, 'the') AS has_span,
        CASE WHEN n = 1 THEN 'UNIQUE' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'ABSENT' END AS status, n::INT AS n, CASE WHEN n > 0 THEN strpos(t, 'the') - 1 END::INT AS span_start, CASE WHEN n > 0 THEN strpos(t, 'the') + 2 END::INT AS span_end, substr(sha256(conv_id || '|' || role || '|' || turn), 1, 16) AS uid,
        substr(sha256('3|' || array_to_string(list_sort(list_distinct([role, 'b', 'a'])), chr(1))), 1, 16) AS names_revision, conv_id * 1000 + turn AS segment_id, turn % 2 = 0 AS starts_han, CASE WHEN turn % 150 <= 130 THEN turn % 150 END::INT AS age, (1000 * 2 ** (turn % 6))::BIGINT AS wait_ms FROM n"""
)
def text_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar text functions over every turn: digits, sentences, spans, ids, revisions, ages and waits."""
    t, turn = F.coalesce("text", F.lit("")), F.col("turn")
    wide = F.translate(turn.cast("string"), "0123456789", "０１２３４５６７８９")
    at = scalars.align(F.lit("the"), t)
    stated = F.concat((turn % 150).cast("string"), F.lit("岁"))
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", normalize_digits(F.concat(wide, F.lit(" 　"), (F.col("conv_id") % 100).cast("string"))).alias("digits"), F.size(scalars.sentences(t, ".!?")).alias("n_sentences"), scalars.contains_span(t, F.lit("the")).alias("has_span"),
        at["status"].alias("status"), at["n"].alias("n"), at["start"].alias("span_start"), at["end"].alias("span_end"), scalars.entity_uid(F.col("conv_id"), F.col("role"), turn).alias("uid"),
        scalars.name_set_revision(F.array("role", F.lit("b"), F.lit("a"), "role"), 3).alias("names_revision"), scalars.segment_id(F.col("conv_id"), turn).alias("segment_id"), scalars.starts_han(F.when(turn % 2 == 0, F.concat(F.lit("汉"), t)).otherwise(t)).alias("starts_han"),
        scalars.extract_age(F.when(turn % 2 == 0, F.concat(F.lit("Anna "), stated)).otherwise(F.concat(stated, F.lit("的Anna"))), F.lit("Anna")).alias("age"), scalars.backoff_ms(F.lit(1000), turn % 6 + 1).alias("wait_ms"),
    )


@query(
    """WITH o AS (SELECT o_orderkey AS k, ['SAD', 'ANGRY', 'NEUTRAL', 'TIRED', 'CALM'][1 + o_orderkey % 5] AS e, ['SLOW', 'NORMAL', 'FAST'][1 + o_orderkey % 3] AS p, ['LOUD', 'NORMAL'][1 + o_orderkey % 2] AS v, ['WARM', 'NEUTRAL', 'ODD', 'SERIOUS'][1 + o_orderkey % 4] AS t, (o_orderkey % 10) / 10 AS i FROM orders),
    x AS (SELECT k, list_filter([CASE e WHEN 'SAD' THEN 'sad' WHEN 'ANGRY' THEN 'angry' WHEN 'CALM' THEN 'calm' END, CASE p WHEN 'SLOW' THEN 'slowly' WHEN 'FAST' THEN 'fast' END, CASE v WHEN 'LOUD' THEN 'loudly' END, CASE t WHEN 'WARM' THEN 'in a warm tone' WHEN 'SERIOUS' THEN 'in a serious tone' END], lambda z: z IS NOT NULL) AS words,
        CASE WHEN e IN ('SAD', 'ANGRY', 'CALM') THEN CASE WHEN i >= 0.7 THEN 'very ' WHEN i < 0.3 THEN 'slightly ' ELSE '' END ELSE '' END AS grade, list_filter([CASE WHEN e = 'TIRED' THEN 'emotion=TIRED' END, CASE WHEN t = 'ODD' THEN 'tone=ODD' END], lambda z: z IS NOT NULL) AS unknown FROM o)
    SELECT k AS o_orderkey, grade || array_to_string(words, ', ') AS instruction, array_to_string(unknown, ',') AS unknown_keys, CASE WHEN len(words) = 0 THEN 'PLAIN' ELSE 'INSTRUCTED' END AS mode FROM x"""
)
def instruction_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instructions compiled from decision fields, with the values that no phrase is known for."""
    fields = {"emotion": pick(order_key(), "SAD", "ANGRY", "NEUTRAL", "TIRED", "CALM"), "pace": pick(order_key(), "SLOW", "NORMAL", "FAST"), "volume": pick(order_key(), "LOUD", "NORMAL"), "tone": pick(order_key(), "WARM", "NEUTRAL", "ODD", "SERIOUS")}
    rows = orders(spark, sf_dir).select("o_orderkey", *(c.alias(n) for n, c in fields.items()), ((order_key() % 10) / 10).alias("intensity"))
    made = rows.select("o_orderkey", render.compile_instruction({n: F.col(n) for n in fields}, F.col("intensity")).alias("i"))
    return made.select("o_orderkey", "i.instruction", F.array_join("i.unknown_keys", ",").alias("unknown_keys"), "i.mode")


UNITS = """u AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 > 0 THEN 'u' END AS unit_id, CASE o_orderkey % 11 WHEN 0 THEN NULL WHEN 1 THEN '   ' WHEN 2 THEN repeat('x', 401) ELSE 'abc' END AS text, CASE WHEN o_orderkey % 5 > 0 THEN 'v' ELSE '' END AS voice_id,
CASE o_orderkey % 13 WHEN 0 THEN NULL WHEN 1 THEN 3.0 ELSE 1.0 END AS speed, CASE WHEN o_orderkey % 17 = 0 THEN -1 ELSE 1 END AS ordinal, CASE WHEN o_orderkey % 19 > 0 THEN 's' END AS speaker, CASE o_orderkey % 29 WHEN 0 THEN 'ODD' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'INSTRUCTED' ELSE 'PLAIN' END END AS mode, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'x' END AS instruction FROM orders),
v AS (SELECT *, CASE WHEN k % 23 = 0 THEN -1 ELSE length(text) END AS span_end FROM u)"""


@query(
    f"""WITH {UNITS} SELECT k AS o_orderkey, array_to_string(list_filter([CASE WHEN unit_id IS NULL THEN 'UNIT_ID_MISSING' END, CASE WHEN text IS NULL THEN 'TEXT_MISSING' END, CASE WHEN trim(text, ' ') = '' THEN 'TEXT_BLANK' END, CASE WHEN length(text) > 400 THEN 'TEXT_TOO_LONG' END, CASE WHEN voice_id = '' THEN 'VOICE_MISSING' END, CASE WHEN speed IS NULL OR speed > 2 THEN 'SPEED_RANGE' END,
        CASE WHEN ordinal < 0 THEN 'ORDINAL_NEGATIVE' END, CASE WHEN speaker IS NULL THEN 'SPEAKER_MISSING' END, CASE WHEN span_end < 0 THEN 'SPAN_INVERTED' END, CASE WHEN span_end <> length(text) THEN 'SPAN_LENGTH' END, CASE WHEN mode = 'ODD' THEN 'MODE_UNKNOWN' END, CASE WHEN mode = 'INSTRUCTED' AND instruction = '' THEN 'INSTRUCTION_MISSING' END], lambda z: z IS NOT NULL), ',') AS faults FROM v"""
)
def unit_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules that each render unit breaks; units are damaged by their order's key."""
    text = F.when(order_key() % 11 == 0, None).when(order_key() % 11 == 1, "   ").when(order_key() % 11 == 2, F.repeat(F.lit("x"), F.lit(401))).otherwise("abc")
    rows = orders(spark, sf_dir).select(
        "o_orderkey", F.when(order_key() % 7 > 0, "u").alias("unit_id"), text.alias("text"), F.when(order_key() % 5 > 0, "v").otherwise("").alias("voice_id"), F.when(order_key() % 13 == 0, None).when(order_key() % 13 == 1, 3.0).otherwise(1.0).alias("speed"), F.when(order_key() % 17 == 0, -1).otherwise(1).alias("ordinal"),
        F.when(order_key() % 19 > 0, "s").alias("speaker"), F.lit(0).alias("span_start"), F.when(order_key() % 23 == 0, -1).otherwise(F.length(text)).alias("span_end"), F.when(order_key() % 29 == 0, "ODD").when(order_key() % 2 == 0, "INSTRUCTED").otherwise("PLAIN").alias("mode"), F.when(order_key() % 3 == 0, "").otherwise("x").alias("instruction"),
    )
    return rows.select("o_orderkey", F.array_join(render.unit_violations(), ",").alias("faults"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'a' WHEN o_orderkey % 4 = 1 THEN 'c' ELSE 'unavailable' END AS route FROM orders")
def speech_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wanted engine (a, b or d) if it runs, else the first fallback that does; a and c run."""
    none = F.array().cast("array<string>")
    fallbacks = F.when(order_key() % 4 == 0, none).when(order_key() % 4 == 1, F.array(F.lit("b"), F.lit("c"))).when(order_key() % 4 == 2, F.array(F.lit("b")))
    engines = spark.createDataFrame([("a", True), ("b", False), ("c", True)], "engine string, available boolean")
    return render.speech_route(orders(spark, sf_dir).select("o_orderkey", pick(order_key(), "a", "b", "d").alias("wanted"), fallbacks.alias("fallbacks")), engines).select("o_orderkey", "route")


@query("SELECT o_orderkey AS unit_id, CASE WHEN o_orderkey % 4 = 0 THEN 'CACHED' WHEN o_orderkey % 2 = 1 THEN 'PLANNED' WHEN o_orderkey % 3 <> o_orderkey % 5 THEN 'STALE' ELSE 'KEEP' END AS action FROM orders")
def job_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to do with each unit: half of them have a job, a quarter an asset of their key."""
    o = orders(spark, sf_dir).select(order_key().alias("unit_id"), F.concat(F.lit("k"), (order_key() % 3).cast("string")).alias("cache_key"), F.concat(F.lit("k"), (order_key() % 5).cast("string")).alias("old_key"))
    jobs = o.where("unit_id % 2 = 0").select("unit_id", F.col("old_key").alias("cache_key"), F.col("unit_id").alias("updated_at"))
    jobs = jobs.unionByName(jobs.select("unit_id", F.lit("k9").alias("cache_key"), (F.col("updated_at") - 1).alias("updated_at")))
    return render.plan_units(o.drop("old_key"), jobs, o.where("unit_id % 4 = 0").drop("old_key")).select("unit_id", "action")


@query("SELECT o_orderkey AS job_id, (1 + o_orderkey % 6)::BIGINT AS attempts, CASE WHEN o_orderkey % 6 >= 4 THEN 'FAILED' ELSE 'RETRY' END AS state, CASE WHEN o_orderkey % 6 < 4 THEN 1000000 + 1000 * (2 ** (o_orderkey % 6))::BIGINT END AS not_before FROM orders")
def job_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed jobs wait twice as long after each attempt, until five are used up."""
    jobs = orders(spark, sf_dir).select(order_key().alias("job_id"), (order_key() % 6).alias("attempts"), F.lit("RUNNING").alias("state"), F.lit(0).cast("long").alias("not_before"))
    return render.fail_jobs(jobs, F.lit(1_000_000).cast("long")).select("job_id", "attempts", "state", "not_before")


@query("SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 4 = 0 THEN 'DONE' WHEN o_orderkey % 2 = 0 AND o_orderstatus = 'O' THEN 'CANCELLED' ELSE o_orderstatus END AS state FROM orders")
def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open jobs of even ids are cancelled, then those of every fourth id finish."""
    jobs = orders(spark, sf_dir).select(order_key().alias("job_id"), F.col("o_orderstatus").alias("state"))
    marked = render.mark_state(jobs, jobs.where("job_id % 2 = 0"), "CANCELLED", ["O"])
    finished = jobs.where("job_id % 4 = 0").select("job_id", F.col("job_id").alias("unit_id"), F.lit(2).alias("version"))
    return render.complete_jobs(marked, finished.limit(0).select("unit_id", "version"), finished)[0]


@query("SELECT o_custkey AS unit_id, max(o_orderkey) AS version FROM orders GROUP BY o_custkey")
def newest_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each unit's assets, old ones and those just finished, the newest version stays."""
    o = orders(spark, sf_dir).select(order_key().alias("job_id"), F.col("o_custkey").alias("unit_id"), order_key().alias("version"))
    assets = o.where("job_id % 2 = 0").select("unit_id", "version")
    return render.complete_jobs(o.select("job_id", F.lit("RUNNING").alias("state")), assets, o.where("job_id % 2 = 1"))[1]


@query("SELECT o_orderkey % 50 AS ordinal, o_custkey AS unit_id, c_name AS name FROM orders JOIN customer ON c_custkey = o_custkey AND c_custkey % 3 > 0")
def assets_asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets in the asker's order, misses left out: customers are assets, and every third one is missing."""
    assets = table(spark, sf_dir, "customer").where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("unit_id"), F.col("c_name").alias("name"))
    return render.assets_in_order(orders(spark, sf_dir).select((order_key() % 50).alias("ordinal"), F.col("o_custkey").alias("unit_id")), assets).select("ordinal", "unit_id", "name")


REVISIONS = "r AS (SELECT o_orderkey AS revision_id, o_custkey AS owner_scope, o_orderkey % 2 AS artifact_type, CASE o_orderstatus WHEN 'F' THEN 'ACTIVE' WHEN 'O' THEN 'BUILDING' ELSE 'SUPERSEDED' END AS state, o_orderkey % 3 AS input_hash FROM orders)"


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.when(F.col("o_orderstatus") == "F", "ACTIVE").when(F.col("o_orderstatus") == "O", "BUILDING").otherwise("SUPERSEDED")
    return orders(spark, sf_dir).select(order_key().alias("revision_id"), F.col("o_custkey").alias("owner_scope"), (order_key() % 2).alias("artifact_type"), made.alias("state"), (order_key() % 3).alias("input_hash"), F.lit(1).alias("algorithm_version"))


@query(f"WITH {REVISIONS} SELECT owner_scope, artifact_type, max(revision_id) AS revision_id FROM r WHERE state = 'ACTIVE' GROUP BY ALL")
def revision_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.heads(revisions(spark, sf_dir)).select("owner_scope", "artifact_type", "revision_id")


@query(
    f"""WITH {REVISIONS}, p AS (SELECT *, revision_id % 10 = 0 AND state IN ('BUILDING', 'ACTIVE') AS chosen FROM r), t AS (SELECT *, max(CASE WHEN chosen THEN revision_id END) OVER (PARTITION BY owner_scope, artifact_type) AS top FROM p)
    SELECT revision_id, CASE WHEN chosen AND revision_id = top THEN 'ACTIVE' WHEN state = 'ACTIVE' AND top IS NOT NULL THEN 'SUPERSEDED' ELSE state END AS state FROM t"""
)
def promoted_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth revision is promoted; its owner's older heads are superseded."""
    r = revisions(spark, sf_dir)
    return versions.promote(r, r.where("revision_id % 10 = 0")).select("revision_id", "state")


@query(f"WITH {REVISIONS}, b AS (SELECT owner_scope, artifact_type, input_hash, max(revision_id) AS existing_id FROM r WHERE state IN ('ACTIVE', 'SUPERSEDED') GROUP BY ALL) SELECT r.revision_id, b.existing_id FROM r LEFT JOIN b USING (owner_scope, artifact_type, input_hash) WHERE r.state = 'BUILDING'")
def reusable_builds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each revision that is being built the newest one of the same input, or null."""
    r = revisions(spark, sf_dir)
    return versions.find_existing(r, r.where("state = 'BUILDING'").select("revision_id", "owner_scope", "artifact_type", "input_hash", "algorithm_version")).select("revision_id", "existing_id")


@query(f"WITH {REVISIONS} SELECT revision_id FROM r WHERE state = 'BUILDING' AND revision_id % 3 > 0")
def interrupted_builds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Builds without a running session: sessions run for every third revision, and one has no revision at all."""
    r = revisions(spark, sf_dir)
    running = r.select(F.when(F.col("revision_id") % 3 == 0, F.col("revision_id")).alias("revision_id"), F.lit("RUNNING").alias("state"))
    return versions.interrupted(r, running).select("revision_id")


@query("SELECT event_id + 1000000 AS event_id, event_id AS undoes, user_id AS target, event_type AS old_value, 'was' AS new_value FROM events WHERE event_id % 9 = 0")
def undone_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reverse events: old and new value swapped."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("target"), F.lit("was").alias("old_value"), F.col("event_type").alias("new_value"))
    return versions.undo(e, e.where("event_id % 9 = 0"), F.col("event_id") + 1_000_000)


@query("SELECT o_orderkey AS from_entity, o_custkey AS to_entity FROM orders WHERE o_orderkey % 100 = 1 OR o_custkey % 100 = 1")
def lineage_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links from orders or to customers whose number ends in 01."""
    links = orders(spark, sf_dir).select(order_key().alias("from_entity"), F.col("o_custkey").alias("to_entity"))
    low = lambda c: links.select(F.col(c).alias("entity")).where("entity % 100 = 1")
    a = versions.lineage_of(links, low("from_entity")).where("from_entity % 100 = 1")
    return a.union(versions.lineage_of(links, low("to_entity")).where("to_entity % 100 = 1")).distinct()


@query("SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.v IS NOT NULL THEN b.v ELSE a.v END AS v FROM (SELECT o_orderkey AS k, o_orderstatus AS v FROM orders WHERE o_orderkey % 3 > 0) a FULL JOIN (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 > 0 THEN 'new' END AS v FROM orders WHERE o_orderkey % 2 = 0) b USING (k)")
def synced_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table synced with what was found: found values win where they aren't null."""
    o = orders(spark, sf_dir)
    return versions.update_then_insert(o.where("o_orderkey % 3 > 0").select(order_key().alias("k"), F.col("o_orderstatus").alias("v")), o.where("o_orderkey % 2 = 0").select(order_key().alias("k"), F.when(order_key() % 5 > 0, "new").alias("v")), ["k"], ["v"])


@query("SELECT o_orderkey AS seq, o_orderpriority AS priority FROM orders WHERE o_orderstatus = 'F'")
def standing_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = orders(spark, sf_dir).select(order_key().alias("seq"), F.col("o_orderpriority").alias("priority"), F.when(F.col("o_orderstatus") == "F", "ACTIVE").otherwise("DISABLED").alias("state"))
    return versions.active_overrides(rules, ["2-HIGH", "1-URGENT"]).select("seq", "priority")


@query(
    """SELECT o_orderkey AS segment_id, CASE o_orderkey % 4 WHEN 0 THEN 'CURRENT' ELSE 'LEGACY' END AS kind, CASE o_orderkey % 4 WHEN 0 THEN o_orderstatus ELSE '' END AS text, CASE o_orderkey % 4 WHEN 1 THEN 'C0' WHEN 2 THEN '' END AS raw_speaker FROM orders WHERE o_orderkey % 4 < 3"""
)
def stored_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored lines of the present version, of the first one, of none stated, and damaged ones: old ones are only shown, damaged ones are left out."""
    o = orders(spark, sf_dir)
    now = decisions.encode_lines(o.where("o_orderkey % 4 = 0").select(order_key().alias("segment_id"), F.col("o_orderstatus").alias("text")), ["segment_id", "text"])
    old = lambda k, rest: o.where(f"o_orderkey % 4 = {k}").select(F.concat(F.lit('{"segment_id":'), order_key().cast("string"), F.lit(rest)).alias("value"))
    lines = now.union(old(1, ',"schemaVersion":1,"speaker":"C0"}')).union(old(2, "}")).union(old(3, ', "broken'))
    read = decisions.decode_lines(lines, "segment_id long, text string").select("segment_id", F.lit("CURRENT").alias("kind"), "text", F.lit(None).cast("string").alias("raw_speaker"))
    legacy = decisions.legacy_lines(lines).where("not speaker_resolvable").select("segment_id", F.lit("LEGACY").alias("kind"), "text", "raw_speaker")
    return read.unionByName(legacy)


@query("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'NARRATOR' WHEN 1 THEN 'UNKNOWN' WHEN 2 THEN 'CHARACTER:' || o_custkey END AS token, CASE o_orderkey % 5 WHEN 0 THEN 'NARRATOR' WHEN 1 THEN 'UNKNOWN' WHEN 2 THEN 'CHARACTER' END AS kind, CASE WHEN o_orderkey % 5 = 2 THEN o_custkey END AS id FROM orders")
def speaker_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local speaker ids as stable tokens, and back; local ids outside the map, and tokens that are none, give nulls."""
    token = decisions.speaker_ref(pick(order_key(), "NARRATOR", "UNKNOWN", "C1", "C2", "x"), F.create_map(F.lit("C1"), F.col("o_custkey")))
    rows = orders(spark, sf_dir).select("o_orderkey", token.alias("token"))
    return rows.select("o_orderkey", "token", decisions.decode_ref(F.col("token")).alias("d")).select("o_orderkey", "token", "d.kind", "d.id")


@query(
    """WITH a AS (SELECT o_orderkey AS k, ['x', 'y'][1 + o_orderkey % 2] AS r, ['x', 'y', 'z'][1 + o_orderkey % 3] AS s, ['x', 'y', NULL, 'w'][1 + o_orderkey // 2 % 4] AS t FROM orders),
    p AS (SELECT *, CASE WHEN t IS NULL THEN 'NO_TEACHER' WHEN r = t AND s = t THEN 'ALL_AGREE' WHEN r = t THEN 'RULE_TEACHER' WHEN s = t THEN 'STUDENT_TEACHER' WHEN r = s THEN 'RULE_STUDENT' ELSE 'ALL_DIFFER' END AS pattern FROM a)
    SELECT k AS o_orderkey, pattern, CASE WHEN k % 7 = 0 THEN 'QUARANTINE' WHEN k % 5 = 0 OR pattern = 'ALL_DIFFER' THEN 'ARBITRATION' WHEN pattern IN ('RULE_STUDENT', 'NO_TEACHER') THEN 'AUDIT' ELSE 'SILVER' END AS route, CASE WHEN k % 3 = 0 THEN 'NARRATOR' WHEN k % 4 < 2 THEN 'UNKNOWN' END AS shortcut FROM p"""
)
def label_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a rule, a student and a teacher agree, where the sample goes, and which decisions need no model."""
    teacher = F.element_at(F.array(F.lit("x"), F.lit("y"), F.lit(None), F.lit("w")), (F.floor(order_key() / 2) % 4 + 1).cast("int"))
    pattern = decisions.agreement(pick(order_key(), "x", "y"), pick(order_key(), "x", "y", "z"), teacher)
    candidates = F.when(order_key() % 4 == 0, F.array().cast("array<string>")).when(order_key() % 4 > 1, F.array(F.lit("a")))
    return orders(spark, sf_dir).select("o_orderkey", pattern.alias("pattern"), decisions.route(pattern, order_key() % 7 != 0, order_key() % 5 == 0).alias("route"), decisions.shortcut(F.when(order_key() % 3 == 0, "NARRATION").otherwise("DIALOGUE"), candidates).alias("shortcut"))


@query(
    """WITH x AS (SELECT o_custkey % 20 AS run, ['ACCEPTED_ALL', 'DOWNGRADE', 'VERIFY', 'REJECT'][1 + o_orderkey % 4] AS outcome FROM orders)
    SELECT run, count(*) AS n, count(*) FILTER (outcome = 'ACCEPTED_ALL') AS n_accepted_all, count(*) FILTER (outcome = 'DOWNGRADE') AS n_downgrade, count(*) FILTER (outcome = 'VERIFY') AS n_verify, count(*) FILTER (outcome = 'REJECT') AS n_reject, round(count(*) FILTER (outcome <> 'REJECT') / count(*), 6) AS coverage FROM x GROUP BY run"""
)
def run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders(spark, sf_dir).select((F.col("o_custkey") % 20).alias("run"), pick(order_key(), "ACCEPTED_ALL", "DOWNGRADE", "VERIFY", "REJECT").alias("outcome"))
    return decisions.runner_stats(rows, ["run"]).withColumn("coverage", F.round("coverage", 6))


@query(
    """SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_orderkey % 5 = 0 THEN 'OWNER_MISSING' WHEN o_orderkey % 5 = 1 THEN 'OWNER_NOT_CANDIDATE' END, CASE WHEN o_orderkey % 3 = 1 THEN 'REFERENCE_NOT_CANDIDATE' END, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 5 IN (1, 2, 3) THEN 'NONE_WITH_OWNER' END, CASE WHEN o_orderkey % 7 < 2 THEN 'CONFIDENCE_RANGE' END], lambda z: z IS NOT NULL), ',') AS faults FROM orders"""
)
def binding_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners are missing, unknown to the list, listed or UNKNOWN; references may be null or unknown; confidences may be null or too large."""
    owner = pick(order_key(), F.lit(None).cast("string"), "q", "a", "b", "UNKNOWN")
    reference = pick(order_key(), F.lit(None).cast("string"), "q", "a")
    faults = decisions.validate_binding(owner, reference, F.when(order_key() % 7 == 0, None).when(order_key() % 7 == 1, 1.5).otherwise(0.5), F.array(F.lit("a"), F.lit("b")), pick(order_key(), "NONE", "OWNED"))
    return orders(spark, sf_dir).select("o_orderkey", F.array_join(faults, ",").alias("faults"))


@query("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'a' WHEN 1 THEN 'a' WHEN 2 THEN 'zz' WHEN 4 THEN 'c' END AS answer, ['STRICT', 'REPAIRABLE', 'OUT_OF_CANDIDATE', 'FAIL', 'STRICT'][1 + o_orderkey % 5] AS verdict FROM orders")
def answer_protocol(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = pick(order_key(), '{"answer": "a"}', 'So: {"answer": "a"}.', '{"answer": "zz"}', "no object", ' {"answer":"c"} ')
    answer, verdict = decisions.protocol_verdict(raw, F.array(F.lit("a")), F.array(F.lit("c")))
    return orders(spark, sf_dir).select("o_orderkey", answer.alias("answer"), verdict.alias("verdict"))


MERGES = "g AS (SELECT o_custkey % 10 AS book, o_orderkey AS seq, CASE WHEN o_orderkey % 3 > 0 THEN 'MERGE' ELSE 'SPLIT' END AS action, o_orderkey % 30 AS source, (o_orderkey + 7) % 30 AS target FROM orders WHERE o_orderstatus = 'F'), e AS (SELECT DISTINCT o_custkey % 10 AS book, o_orderkey % 40 AS entity FROM orders)"
CLUSTERS = f"{MERGES}, t AS (SELECT book, seq, source AS entity FROM g UNION ALL SELECT book, seq, target FROM g WHERE action = 'MERGE'), l AS (SELECT book, entity, max(seq) AS seq FROM t GROUP BY ALL), c AS (SELECT e.book, e.entity, coalesce('cluster-' || l.seq, 'entity-' || e.entity) AS cluster FROM e LEFT JOIN l USING (book, entity))"


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = orders(spark, sf_dir).withColumn("book", F.col("o_custkey") % 10)
    log = o.where("o_orderstatus = 'F'").select("book", order_key().alias("seq"), F.when(order_key() % 3 > 0, "MERGE").otherwise("SPLIT").alias("action"), (order_key() % 30).alias("source"), ((order_key() + 7) % 30).alias("target"))
    return identity.replay_merges(log, o.select("book", (order_key() % 40).alias("entity")), ["book"])


@query(f"WITH {CLUSTERS} SELECT book, entity, cluster FROM c")
def merged_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters after a log of merges and splits: the last row that names an entity decides."""
    return clusters(spark, sf_dir)


@query(f"WITH {CLUSTERS} SELECT book, cluster, array_to_string(list_sort(list_distinct(list('n' || entity % 7))), ',') AS aliases FROM c GROUP BY book, cluster")
def cluster_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = clusters(spark, sf_dir)
    named = members.select("book", "entity", F.concat(F.lit("n"), (F.col("entity") % 7).cast("string")).alias("name"))
    return identity.aliases_of(members, named, ["book"]).select("book", "cluster", F.array_join("aliases", ",").alias("aliases"))


@query(
    """WITH p AS (SELECT l_suppkey AS a, l_partkey % 50 AS b, count(*)::DOUBLE AS s, bool_or(l_returnflag = 'R') AS h FROM lineitem WHERE l_suppkey <> l_partkey % 50 GROUP BY ALL), m AS (SELECT a % 8 AS ca, b % 8 AS cb, s, h FROM p WHERE a % 8 <> b % 8)
    SELECT least(ca, cb) AS cluster_a, greatest(ca, cb) AS cluster_b, sum(s) AS strength, bool_or(h) AS hard_negative FROM m GROUP BY 1, 2"""
)
def cluster_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence between clusters, summed over all pairs of their members."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 50).alias("b"), (F.col("l_returnflag") == "R").alias("h")).where("a <> b")
    pairs = li.groupBy("a", "b").agg(F.count("*").cast("double").alias("strength"), F.bool_or("h").alias("hard_negative"))
    nodes = pairs.select(F.col("a").alias("entity")).union(pairs.select("b")).distinct()
    return identity.cluster_pair_evidence(pairs, nodes.select("entity", (F.col("entity") % 8).alias("cluster")))


@query("WITH c AS (SELECT conv_id, role AS candidate, min(turn) AS idx FROM conversations GROUP BY ALL) SELECT x.conv_id, x.idx AS i, y.idx AS j, x.candidate AS a, y.candidate AS b FROM c x JOIN c y ON x.conv_id = y.conv_id AND x.idx < y.idx")
def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of each conversation's speakers, the earlier one first."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id", F.col("role").alias("candidate")).agg(F.min("turn").alias("idx"))
    return identity.candidate_pairs(c, ["conv_id"]).select("conv_id", "i", "j", "a", "b")


@query(
    """WITH o AS (SELECT o_custkey % 10 AS book, ['MENTION', 'ALIAS', 'ODD', 'VOICE_PHASE', 'MERGE', 'TEMP_VOICE', 'ATTRIBUTE'][1 + o_orderkey % 7] AS type FROM orders), r AS (SELECT *, CASE type WHEN 'MENTION' THEN 'mention' WHEN 'ALIAS' THEN 'evidence' WHEN 'VOICE_PHASE' THEN 'interval' WHEN 'MERGE' THEN 'merge' WHEN 'TEMP_VOICE' THEN 'event' WHEN 'ATTRIBUTE' THEN 'attribute' END AS target FROM o)
    SELECT book, CASE WHEN target IS NULL THEN 'REJECTED' ELSE type END AS type, coalesce(target, 'none') AS target, count(*) AS n FROM r GROUP BY ALL"""
)
def observation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations dealt to the tables that they feed, with counts by type; each type's rows are found in its table again."""
    rows = orders(spark, sf_dir).select((F.col("o_custkey") % 10).alias("book"), pick(order_key(), "MENTION", "ALIAS", "ODD", "VOICE_PHASE", "MERGE", "TEMP_VOICE", "ATTRIBUTE").alias("type"))
    parts, counts = identity.compile_observations(rows, ["book"])
    placed = None
    for name, part in parts.items():
        got = part.groupBy("book", "type").agg(F.count("*").alias("placed")).withColumn("target", F.lit(name))
        placed = got if placed is None else placed.unionByName(got)
    both = counts.join(placed, ["book", "type"], "left").where("placed is null or placed = n")
    return both.select("book", "type", F.coalesce("target", F.lit("none")).alias("target"), "n")


@query(
    """WITH m AS (SELECT o_custkey % 10 AS book, 'n' || o_custkey % 13 AS name, o_orderkey AS line_no, ['M', 'F', 'F', NULL][1 + o_orderkey % 4] AS gender, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 90 END AS age, ['cue', 'dialogue'][1 + o_orderkey % 2] AS evidence, 'a' || o_orderkey % 6 AS alias FROM orders)
    SELECT book, name, count(*) AS n_mentions, min(line_no) AS first_line, CASE WHEN sum(CASE gender WHEN 'F' THEN -1 WHEN 'M' THEN 1 ELSE 0 END) > 0 THEN 'M' WHEN sum(CASE gender WHEN 'F' THEN -1 WHEN 'M' THEN 1 ELSE 0 END) < 0 THEN 'F' ELSE 'UNKNOWN' END AS gender, arg_max(age, line_no) FILTER (age IS NOT NULL) AS age,
        (CASE count(DISTINCT evidence) WHEN 2 THEN 0.7 WHEN 1 THEN 0.5 END)::DOUBLE AS confidence, array_to_string(list_sort(list_distinct(list(alias)))[1:4], ',') AS aliases FROM m GROUP BY book, name"""
)
def character_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = orders(spark, sf_dir).select(
        (F.col("o_custkey") % 10).alias("book"), F.concat(F.lit("n"), (F.col("o_custkey") % 13).cast("string")).alias("name"), order_key().alias("line_no"), pick(order_key(), "M", "F", "F", F.lit(None).cast("string")).alias("gender"), F.when(order_key() % 5 == 0, order_key() % 90).alias("age"), pick(order_key(), "cue", "dialogue").alias("evidence"), F.concat(F.lit("a"), (order_key() % 6).cast("string")).alias("alias"),
    )
    return identity.profiles(m, ["book"]).withColumn("aliases", F.array_join("aliases", ","))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN 'user' ELSE c_name END AS name, CASE WHEN c_custkey % 3 = 0 THEN -1 ELSE c_nationkey END AS nation FROM customer")
def user_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User values win, column by column, where they aren't null."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_nationkey").cast("long").alias("nation"))
    own = rows.where("c_custkey % 3 = 0").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, "user").alias("name"), F.lit(-1).cast("long").alias("nation"))
    return identity.with_overrides(rows, own, ["c_custkey"], ["name", "nation"])


@query(
    """WITH c AS (SELECT o_custkey % 10 AS book, o_custkey % 17 AS n, count(*) AS m, count(*) FILTER (o_orderstatus = 'F') AS d, min(o_orderkey) AS a, max(o_orderkey) AS z FROM orders GROUP BY ALL), r AS (SELECT book, 'n' || CASE WHEN n % 4 = 3 THEN n - 1 ELSE n END AS canonical, sum(m)::BIGINT AS m, sum(d)::BIGINT AS d, min(a) AS a, max(z) AS z FROM c GROUP BY ALL)
    SELECT book, canonical, m AS n_mentions, d AS n_dialogue, round(0.5 * m / max(m) OVER () + 0.3 * d / greatest(m, 1) + 0.2 * least(z - a, 1000) / 1000, 6) AS importance FROM r"""
)
def character_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance of characters, with every fourth name an alias of the one before it."""
    n = F.col("o_custkey") % 17
    name = lambda x: F.concat(F.lit("n"), x.cast("string"))
    o = orders(spark, sf_dir).select((F.col("o_custkey") % 10).alias("book"), n.alias("n"), "o_orderkey", "o_orderstatus")
    rows = o.groupBy("book", name(F.col("n")).alias("name")).agg(F.count("*").alias("n_mentions"), F.count_if(F.col("o_orderstatus") == "F").alias("n_dialogue"), F.min("o_orderkey").alias("first_at"), F.max("o_orderkey").alias("last_at"))
    aliases = o.where("n % 4 = 3").select("book", name(F.col("n")).alias("name"), name(F.col("n") - 1).alias("canonical")).distinct()
    return identity.importance(rows, aliases).select("book", "canonical", "n_mentions", "n_dialogue", "importance")


PROTOCOL = "x AS (SELECT o_custkey % 10 AS run, ['STRICT', 'REPAIRABLE', 'FAIL', 'OUT_OF_CANDIDATE'][1 + o_orderkey % 4] AS verdict, ['a', 'UNKNOWN', NULL][1 + o_orderkey % 3] AS gold, ['a', 'b', 'UNKNOWN', 'a', NULL][1 + o_orderkey % 5] AS pred FROM orders)"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return orders(spark, sf_dir).select(
        "o_orderkey", (F.col("o_custkey") % 10).alias("run"), pick(order_key(), "STRICT", "REPAIRABLE", "FAIL", "OUT_OF_CANDIDATE").alias("verdict"), pick(order_key(), "a", "UNKNOWN", none).alias("gold"), pick(order_key(), "a", "b", "UNKNOWN", "a", none).alias("pred"),
        F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), 1, (1 + order_key() % 3).cast("int")).alias("candidates"),
    )


@query(
    f"""WITH {PROTOCOL} SELECT run, count(*) AS n_samples, round(count(*) FILTER (verdict = 'STRICT') / count(*), 6) AS strict_valid, round(count(*) FILTER (verdict IN ('STRICT', 'REPAIRABLE')) / count(*), 6) AS repairable_valid, count(*) FILTER (gold IS NOT NULL) AS gold_subset, round(count(*) FILTER (gold = pred) / greatest(count(*) FILTER (gold IS NOT NULL), 1), 6) AS gold_accuracy,
    round(count(*) FILTER (gold = 'UNKNOWN' AND pred = 'UNKNOWN') / count(*) FILTER (gold = 'UNKNOWN'), 6) AS unknown_recall, round(count(*) FILTER (gold IS NULL AND pred = 'UNKNOWN') / greatest(count(*) FILTER (gold IS NULL), 1), 6) AS unknown_on_ungolded FROM x GROUP BY run"""
)
def protocol_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = evaluation.protocol_rates(predictions(spark, sf_dir), ["run"]).drop("out_of_candidate")
    return got.select("run", "n_samples", "gold_subset", *(F.round(c, 6).alias(c) for c in ("strict_valid", "repairable_valid", "gold_accuracy", "unknown_recall", "unknown_on_ungolded")))


@query(
    """WITH x AS (SELECT 1 + o_orderkey % 3 AS k, ['a', 'UNKNOWN', NULL][1 + o_orderkey % 3] AS gold, ['a', 'b', 'UNKNOWN', 'a', NULL][1 + o_orderkey % 5] AS pred FROM orders)
    SELECT k::INT AS k, count(*) AS n, round(count(*) FILTER (pred = gold) / count(*), 6) AS accuracy, round(count(*) FILTER (pred = 'b' AND k = 1) / count(*), 6) AS violations, round(count(*) FILTER (pred = 'UNKNOWN') / count(*), 6) AS unknown FROM x GROUP BY k"""
)
def accuracy_by_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.by_cardinality(predictions(spark, sf_dir)).select("k", "n", *(F.round(c, 6).alias(c) for c in ("accuracy", "violations", "unknown")))


@query("WITH x AS (SELECT o_orderstatus AS a, substr(o_orderpriority, 1, 1) AS b, count(*) AS n FROM orders GROUP BY ALL) SELECT a, b, n FROM x UNION ALL SELECT a, 'ALL', sum(n)::BIGINT FROM x GROUP BY a UNION ALL SELECT 'ALL', 'ALL', sum(n)::BIGINT FROM x")
def two_level_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.two_level_counts(orders(spark, sf_dir).select(F.col("o_orderstatus").alias("a"), F.left("o_orderpriority", F.lit(1)).alias("b")), "a", "b")


@query("SELECT o_orderpriority AS kind, count(*) AS n, round(count(*) FILTER (o_orderkey % 3 = o_orderkey % 2) / count(*), 6) AS agreement, round(count(*) FILTER (o_orderkey % 4 > 0) / count(*), 6) AS stability FROM orders GROUP BY ALL")
def judge_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement with a judge, and the share of samples whose repeats all give one answer."""
    rows = orders(spark, sf_dir).select(F.col("o_orderpriority").alias("kind"), (order_key() % 3).alias("answer"), (order_key() % 2).alias("judge"), F.array(F.lit(1), F.lit(1), F.when(order_key() % 4 > 0, 1).otherwise(2)).alias("repeats"))
    return evaluation.agreement_by_kind(rows, ["kind"]).select("kind", "n", F.round("agreement", 6).alias("agreement"), F.round("stability", 6).alias("stability"))


@query("SELECT 's' || o_custkey % 40 AS speaker, count(*) AS n FROM orders WHERE o_custkey % 40 % 3 = 0 GROUP BY ALL")
def rejected_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by speakers that the name gate rejected."""
    name = lambda c: F.concat(F.lit("s"), c.cast("string"))
    rejected = spark.range(0, 60, 3).select(name(F.col("id")).alias("surface"))
    return evaluation.nonperson_speakers(orders(spark, sf_dir).select(name(F.col("o_custkey") % 40).alias("speaker")), rejected)


@query(
    """WITH x AS (SELECT o_custkey % 10 AS run, o_orderkey AS seq, CASE WHEN o_orderkey % 9 > 0 THEN CASE WHEN o_orderkey % 8 = 0 THEN '```x' ELSE 'abcd' END END AS text, CASE WHEN o_orderkey % 7 > 0 THEN 's' END AS speaker, CASE WHEN o_orderkey % 50 = 0 THEN 0 ELSE 10 * o_orderkey END AS a, o_orderkey % 6 AS d FROM orders), y AS (SELECT *, coalesce(lag(a) OVER (PARTITION BY run ORDER BY seq) > a, false) AS back FROM x)
    SELECT run, count(*) AS n, count(*) FILTER (text IS NULL OR speaker IS NULL) AS n_missing, count(*) FILTER (text = '```x') AS n_leaks, count(*) FILTER (text IS NOT NULL AND d = 0) AS n_span, count(*) FILTER (back) AS n_order FROM y GROUP BY run"""
)
def run_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken invariants of a run's lines: missing fields, leaked control text, span lengths and order."""
    start = F.when(order_key() % 50 == 0, 0).otherwise(10 * order_key())
    text = F.when(order_key() % 9 > 0, F.when(order_key() % 8 == 0, "```x").otherwise("abcd"))
    rows = orders(spark, sf_dir).select((F.col("o_custkey") % 10).alias("run"), order_key().alias("seq"), text.alias("text"), F.when(order_key() % 7 > 0, "s").alias("speaker"), start.alias("span_start"), (start + 4 + F.when(order_key() % 6 == 0, 1).otherwise(0)).alias("span_end"))
    return evaluation.gate_invariants(rows, ["run"], "seq")


@query("WITH x AS (SELECT (o_orderkey % 2 = 0)::INT AS two, (o_orderkey % 3 = 0)::INT AS three, coalesce(CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 5 = 1 END, false)::INT AS five FROM orders) SELECT two + three + five AS score, count(*) AS n, sum(two)::BIGINT AS two, sum(three)::BIGINT AS three, sum(five)::BIGINT AS five FROM x GROUP BY 1")
def signal_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals = {"two": order_key() % 2 == 0, "three": order_key() % 3 == 0, "five": F.when(order_key() % 5 > 0, order_key() % 5 == 1)}
    return evaluation.signal_histogram(orders(spark, sf_dir), signals)


@query(
    """WITH x AS (SELECT o_custkey % 10 AS run, list_distinct([o_orderkey % 3, o_orderkey % 5]) AS g, list_distinct([o_orderkey % 4, o_orderkey % 3]) AS p FROM orders), y AS (SELECT run, sum(len(list_intersect(g, p)))::BIGINT AS hit, sum(len(g))::BIGINT AS gold, sum(len(p))::BIGINT AS pred FROM x GROUP BY run)
    SELECT run, hit, gold, pred, round(hit / greatest(pred, 1), 6) AS precision, round(hit / greatest(gold, 1), 6) AS recall FROM y"""
)
def mention_micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders(spark, sf_dir).select((F.col("o_custkey") % 10).alias("run"), F.array(order_key() % 3, order_key() % 5).alias("gold_mentions"), F.array(order_key() % 4, order_key() % 3).alias("pred_mentions"))
    return evaluation.mention_scores(rows, ["run"]).withColumns({c: F.round(c, 6) for c in ("precision", "recall")})


@query(
    """WITH x AS (SELECT o_custkey % 10 AS run, ['a', 'UNKNOWN', NULL][1 + o_orderkey % 3] AS go, ['a', 'UNKNOWN'][1 + o_orderkey % 2] AS po, ['r', NULL][1 + o_orderkey // 2 % 2] AS gr, ['r', 'q', NULL][1 + o_orderkey // 3 % 3] AS pr FROM orders)
    SELECT run, count(*) AS n, round(count(*) FILTER (go = po) / greatest(count(go), 1), 6) AS owner_accuracy, round(count(*) FILTER (gr = pr) / greatest(count(gr), 1), 6) AS ref_accuracy, round(count(*) FILTER (go = po AND gr = pr) / greatest(count(*) FILTER (go IS NOT NULL AND gr IS NOT NULL), 1), 6) AS joint_accuracy,
        round(count(*) FILTER (go = 'UNKNOWN' AND po = 'UNKNOWN') / greatest(count(*) FILTER (po = 'UNKNOWN'), 1), 6) AS unknown_precision, round(count(*) FILTER (go = 'UNKNOWN' AND po = 'UNKNOWN') / greatest(count(*) FILTER (go = 'UNKNOWN'), 1), 6) AS unknown_recall FROM x GROUP BY run"""
)
def binding_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    none, half, third = F.lit(None).cast("string"), F.floor(order_key() / 2), F.floor(order_key() / 3)
    rows = orders(spark, sf_dir).select((F.col("o_custkey") % 10).alias("run"), pick(order_key(), "a", "UNKNOWN", none).alias("gold_owner"), pick(order_key(), "a", "UNKNOWN").alias("pred_owner"), pick(half, "r", none).alias("gold_ref"), pick(third, "r", "q", none).alias("pred_ref"))
    got = evaluation.binding_scores(rows, ["run"])
    return got.select("run", "n", *(F.round(c, 6).alias(c) for c in got.columns[2:]))


@query("SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'FOURTH' WHEN o_orderkey % 2 = 0 THEN 'SECOND' ELSE 'CLEAN' END AS reason, count(*) AS n FROM orders GROUP BY 1")
def pollution_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.pollution_audit(orders(spark, sf_dir), [("FOURTH", order_key() % 4 == 0), ("SECOND", order_key() % 2 == 0)])


@query("WITH m AS (SELECT o_orderstatus AS run, substr(o_orderpriority, 1, 1) AS metric, count(*) AS value FROM orders GROUP BY ALL) SELECT m.run, m.metric, m.value, b.value AS base_value, m.value - b.value AS delta FROM m LEFT JOIN m b ON b.run = 'F' AND b.metric = m.metric")
def run_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = orders(spark, sf_dir).groupBy(F.col("o_orderstatus").alias("run"), F.left("o_orderpriority", F.lit(1)).alias("metric")).agg(F.count("*").alias("value"))
    return evaluation.metric_deltas(m, "F").select("run", "metric", "value", "base_value", "delta")


@query("SELECT o_custkey % 10 AS book, 'n' || o_custkey AS name, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) >= 12")
def frequent_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.entity_frequency(orders(spark, sf_dir).select((F.col("o_custkey") % 10).alias("book"), F.concat(F.lit("n"), F.col("o_custkey").cast("string")).alias("name")), ["book"], 12)


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus, o_orderkey) = 1")
def first_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each key in a given order."""
    return sampling.keep_first(orders(spark, sf_dir), ["o_custkey"], ["o_orderstatus", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query(
    """WITH a AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS t, o_orderpriority AS g FROM orders WHERE o_orderstatus = 'F'), f AS (SELECT o_orderkey FROM a ORDER BY t, g LIMIT 30),
    b AS (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS t, o_orderpriority AS g FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM f)), s AS (SELECT o_orderkey FROM b ORDER BY t, g LIMIT 20) SELECT o_orderkey, 'filled' AS layer FROM f UNION ALL SELECT o_orderkey, 'any' FROM s"""
)
def layered_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two layers of a sample, in turn from all priorities; the second takes nothing that the first has."""
    layers = [("filled", F.col("o_orderstatus") == "F", 30), ("any", F.lit(True), 20)]
    return sampling.layered_round_robin(orders(spark, sf_dir), layers, "o_orderpriority", "o_orderkey", F.col("o_orderkey")).select("o_orderkey", "layer")


@query("SELECT o_orderkey, (o_orderkey % 7 * 10 + CASE WHEN o_orderstatus = 'P' THEN 5 ELSE 0 END)::BIGINT AS score FROM orders ORDER BY score DESC, o_orderkey LIMIT 25")
def priority_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the highest scores, ties by key: a top-k report."""
    return sampling.priority_top(orders(spark, sf_dir), order_key() % 7 * 10 + F.when(F.col("o_orderstatus") == "P", 5).otherwise(0), 25, "o_orderkey").select("o_orderkey", "score")


@query("SELECT o_orderkey, (o_orderkey % 2 = 0)::INT + (o_orderkey % 3 = 0)::INT + (o_orderstatus = 'F')::INT AS hardness, CASE WHEN o_orderpriority LIKE '1%' THEN 'urgent' WHEN o_orderpriority LIKE '%LOW%' THEN 'low' ELSE 'NONE' END AS bucket FROM orders")
def hardness_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals = [order_key() % 2 == 0, order_key() % 3 == 0, F.col("o_orderstatus") == "F"]
    return orders(spark, sf_dir).select("o_orderkey", sampling.hardness(signals).alias("hardness"), sampling.bucket_of(F.col("o_orderpriority"), [("urgent", "^1"), ("low", "LOW")]).alias("bucket"))


@query("SELECT o_custkey, o_orderkey AS line_no, n::BIGINT AS chapter_no FROM (SELECT *, sum((o_orderpriority LIKE '1%')::INT) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n BETWEEN 1 AND 2")
def first_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders from the first urgent one on, until two urgent ones have passed."""
    rows = orders(spark, sf_dir).withColumn("line_no", order_key())
    return sampling.from_first_chapter(rows, ["o_custkey"], F.col("o_orderpriority").startswith("1"), 2).select("o_custkey", "line_no", "chapter_no")


@query(
    """WITH s AS (SELECT o_orderkey AS segment_id, 'b' || o_custkey % 10 AS book, t.task, CASE t.task WHEN 'SPEAKER' THEN o_orderstatus WHEN 'IDENTITY' THEN 'x|' || o_orderstatus ELSE o_orderpriority END AS target FROM orders, (VALUES ('SPEAKER'), ('IDENTITY'), ('VOICE')) AS t(task) WHERE o_orderkey % 3 > 0)
    SELECT segment_id, task, target, substr(sha256(book || '|' || segment_id || '|' || task), 1, 16) AS sample_id FROM s"""
)
def task_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three training samples for each segment that is spoken."""
    rows = orders(spark, sf_dir).select(F.concat(F.lit("b"), (F.col("o_custkey") % 10).cast("string")).alias("book_hash"), order_key().alias("segment_id"), F.lit("t").alias("text"), F.array(F.lit("x"), "o_orderstatus").alias("candidates"), F.col("o_orderstatus").alias("speaker"), F.col("o_orderpriority").alias("action"), F.when(order_key() % 3 == 0, "NARRATION").otherwise("SPEECH").alias("type"))
    ids = rows.select("segment_id", "book_hash")
    made = generators.task_samples(rows)
    key = F.substring(F.sha2(F.concat_ws("|", "book_hash", F.col("segment_id").cast("string"), "task").cast("binary"), 256), 1, 16)
    named = ids.crossJoin(F.broadcast(spark.createDataFrame([("SPEAKER",), ("IDENTITY",), ("VOICE",)], "task string"))).select("segment_id", key.alias("sample_id"))
    return made.join(named, "sample_id").select("segment_id", "task", "target", "sample_id")


@query("SELECT o_orderkey, 'Who speaks?' || chr(10) || chr(10) || '[CANDIDATES]' || chr(10) || 'C1 a' || chr(10) || 'C2 ' || o_orderstatus || CASE WHEN o_orderkey % 2 = 0 THEN chr(10) || chr(10) || '[NOTE]' || chr(10) || o_orderpriority ELSE '' END AS prompt FROM orders")
def prompt_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of a title and sections; empty sections are left out."""
    note = F.when(order_key() % 2 == 0, F.col("o_orderpriority")).otherwise("")
    return orders(spark, sf_dir).select("o_orderkey", generators.prompt(F.lit("Who speaks?"), [("CANDIDATES", generators.candidate_list(F.array(F.lit("a"), "o_orderstatus"))), ("NOTE", note)]).alias("prompt"))


@query("SELECT o_orderkey, ['MENTION', 'EMBODIMENT', NULL, 'TEMP_VOICE', 'VOICE_PHASE'][1 + o_orderkey % 5] AS type, CASE WHEN o_orderkey % 5 <> 2 THEN o_custkey END AS position FROM orders")
def legacy_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old behaviour records as observations; unknown behaviours are none."""
    rows = orders(spark, sf_dir).select("o_orderkey", generators.legacy_observation(pick(order_key(), "Appear", "disguise", "dance", "VOICE_CHANGE", "grow"), F.lit("x"), F.lit(None).cast("string"), F.col("o_custkey")).alias("o"))
    return rows.select("o_orderkey", "o.type", "o.position")


@query("SELECT conv_id, turn, contains(text, ' it ') AS pronoun, coalesce(contains(text, ' it ') AND (contains(p, 'the') OR contains(p, 'and')), false) AS resolvable FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations)")
def pronoun_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a turn has a pronoun, and whether the turn before names something that it may stand for."""
    from pyspark.sql import Window as W

    before = F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.array_compact(F.array(before)).alias("before"))
    flags = generators.pronoun_flags(F.col("text"), F.col("before"), " it ", F.array(F.lit("the"), F.lit("and")))
    return rows.select("conv_id", "turn", flags.alias("f")).select("conv_id", "turn", "f.pronoun", "f.resolvable")


@query("SELECT o_orderkey AS sample_id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS rule_answer, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 4 = 0 END AS rule_valid, CASE WHEN o_orderkey % 3 = 0 THEN 'm' END AS model_answer, CASE WHEN o_orderkey % 3 = 0 THEN true END AS model_valid FROM orders WHERE o_orderkey % 5 > 0")
def label_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases that aren't done yet, with each arm's answer beside them."""
    cases = orders(spark, sf_dir).select(order_key().alias("sample_id"), "o_orderstatus")
    rule = cases.where("sample_id % 2 = 0").select("sample_id", F.col("o_orderstatus").alias("answer"), (F.col("sample_id") % 4 == 0).alias("valid"))
    model = cases.where("sample_id % 3 = 0").select("sample_id", F.lit("m").alias("answer"), F.lit(True).alias("valid"))
    left = generators.pending(cases.select("sample_id"), cases.where("sample_id % 5 = 0"))
    return generators.label_sheet(left, {"rule": rule, "model": model})


@query("SELECT o_orderkey, nullif(array_to_string(list_filter([CASE WHEN o_orderkey % 2 = 0 THEN 'phase=' || o_orderstatus END, CASE WHEN o_orderkey % 3 = 0 THEN 'override=x' END, CASE WHEN o_orderkey % 5 = 0 THEN 'body=b' END], lambda z: z IS NOT NULL), ';'), '') AS state FROM orders")
def state_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).select("o_orderkey", state.state_summary(F.when(order_key() % 2 == 0, F.col("o_orderstatus")), F.when(order_key() % 3 == 0, "x"), F.when(order_key() % 5 == 0, "b")).alias("state"))


@query(
    """WITH x AS (SELECT o_orderkey AS k, ['al', 'guard', 'bo', NULL][1 + o_orderkey % 4] AS s, CASE o_orderkey % 3 WHEN 0 THEN ['q', 'al'] WHEN 1 THEN ['guard', 'q'] ELSE ['q', 'r'] END AS m FROM orders)
    SELECT k AS o_orderkey, CASE WHEN s = 'al' THEN 'Alice' WHEN k % 3 = 0 THEN 'Alice' WHEN s = 'bo' THEN 'bo' WHEN s IS NULL AND k % 3 = 1 THEN 'q' END AS resolved FROM x"""
)
def alias_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speakers by layers: an alias, the first mention with an alias, no role word, the only mention left."""
    mentions = F.when(order_key() % 3 == 0, F.array(F.lit("q"), F.lit("al"))).when(order_key() % 3 == 1, F.array(F.lit("guard"), F.lit("q"))).otherwise(F.array(F.lit("q"), F.lit("r")))
    rows = orders(spark, sf_dir).select("o_orderkey", pick(order_key(), "al", "guard", "bo", F.lit(None).cast("string")).alias("speaker"), mentions.alias("mentions"))
    return state.layered_resolver(rows, spark.createDataFrame([("al", "Alice")], "surface string, canonical string"), ["guard"]).select("o_orderkey", "resolved")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'FOUND' ELSE 'MISSING' END AS status FROM orders")
def fixture_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected fixtures and whether an output was found for each."""
    o = orders(spark, sf_dir).select("o_orderkey")
    return integrity.present(o, o.where("o_orderkey % 3 = 0"), "o_orderkey")


@query("WITH n AS (SELECT 'customer' AS t, count(*) AS n FROM customer UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'orders', count(*) FROM orders) SELECT t AS table_name, n AS n_rows FROM n WHERE t <> 'nation'")
def lost_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables that lost rows in a migration, or went missing: customers lose some, orders are gone."""
    t = {n: table(spark, sf_dir, n) for n in ("customer", "nation", "orders")}
    after = {"customer": t["customer"].where("c_custkey % 2 = 0"), "nation": t["nation"]}
    return integrity.preserved(integrity.table_counts(spark, t), integrity.table_counts(spark, after)).select("table_name", "n_rows")


@query("SELECT 'late_orders' AS \"check\", count(*) AS n_bad FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'no_nation', count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey % 5 > 0)")
def issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each check with its number of bad rows."""
    bad = integrity.orphans(table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation").where("n_nationkey % 5 > 0"), "c_nationkey", "n_nationkey")
    return integrity.issues({"late_orders": orders(spark, sf_dir).where("o_orderstatus = 'P'"), "no_nation": bad})
