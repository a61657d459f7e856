"""Synthetic corpora: templates crossed with small dimension tables, drawn by hash; and the task samples of a segment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rosters(names: DataFrame, sizes: list[int], seed: int, per_size: int) -> DataFrame:
    """Rosters of names: roster_id, k, names, drawn by the hash order of (seed, roster, name). Name lists are dimension tables of at most 10000 rows."""
    if names.limit(10_001).count() > 10_000:
        raise ValueError("a name list of more than 10000 rows is no dimension table")
    ids = names.sparkSession.range(per_size).crossJoin(names.sparkSession.createDataFrame([(k,) for k in sizes], "k int")).select(F.col("id").alias("nth"), "k")
    drawn = ids.crossJoin(F.broadcast(names.select("name"))).withColumn("r", F.xxhash64(F.lit(seed), F.col("nth"), F.col("k"), F.col("name")))
    return drawn.groupBy("nth", "k").agg(F.slice(F.sort_array(F.collect_list(F.struct("r", "name"))), 1, F.col("k")).alias("s")).select(F.concat_ws("-", "k", "nth").alias("roster_id"), "k", F.col("s.name").alias("names"))


def fill_templates(templates: DataFrame, roster: DataFrame, seed: int) -> DataFrame:
    """Each template with each roster and each gold position: sample_id, text, gold, candidates. ``{S}`` is the gold name and ``{O}`` another one."""
    pos = F.explode(F.sequence(F.lit(0), F.col("k") - 1))
    rows = roster.select("roster_id", "k", "names", pos.alias("gold_at")).crossJoin(F.broadcast(templates.select("template_id", "template")))
    gold = F.get("names", F.col("gold_at"))
    other = F.get("names", F.pmod(F.col("gold_at") + 1 + F.pmod(F.xxhash64(F.lit(seed), "roster_id", "template_id"), F.greatest(F.col("k") - 1, F.lit(1))), F.col("k")).cast("int"))
    text = F.replace(F.replace("template", F.lit("{S}"), gold), F.lit("{O}"), other)
    return rows.select(F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), "roster_id", "template_id", F.col("gold_at").cast("string")).cast("binary"), 256), 1, 16).alias("sample_id"), text.alias("text"), gold.alias("gold"), F.col("names").alias("candidates"), "gold_at")


def dedup_two_levels(samples: DataFrame, names: str = "candidates") -> DataFrame:
    """One sample of each text, then one of each text with its names taken out."""
    by_text = samples.groupBy("text").agg(F.min(F.struct("sample_id", *[c for c in samples.columns if c not in ("text", "sample_id")])).alias("r")).select("text", "r.*")
    bare = F.aggregate(F.col(names), F.col("text"), lambda a, n: F.replace(a, n, F.lit("X")))
    return by_text.withColumn("__bare", bare).groupBy("__bare").agg(F.min(F.struct("sample_id", *[c for c in samples.columns if c != "sample_id"])).alias("r")).select("r.*").select(*samples.columns)


def task_samples(segments: DataFrame) -> DataFrame:
    """Three samples for each speech segment: SPEAKER, IDENTITY (of its candidates) and VOICE, with ids from the segment's."""
    tasks = F.array(*(F.struct(F.lit(t).alias("task"), target.cast("string").alias("target")) for t, target in (("SPEAKER", F.col("speaker")), ("IDENTITY", F.array_join("candidates", "|")), ("VOICE", F.col("action")))))
    rows = segments.where("type <> 'NARRATION'").select("book_hash", "segment_id", "text", "candidates", F.explode(tasks).alias("t"))
    key = F.substring(F.sha2(F.concat_ws("|", "book_hash", F.col("segment_id").cast("string"), "t.task").cast("binary"), 256), 1, 16)
    return rows.select(key.alias("sample_id"), "t.task", "book_hash", F.struct("text", "candidates").alias("input"), "t.target")


def permuted(samples: DataFrame, variants: Column) -> DataFrame:
    """A row for each variant of a sample's candidates."""
    return samples.select("*", F.posexplode(variants).alias("variant", "permuted"))


def relabel_empty(rows: DataFrame, answers: DataFrame, key: str = "sample_id") -> DataFrame:
    """Rows without mentions take the answers that stand in their text; others stay."""
    side = answers.select(key, F.col("mentions").alias("__new"))
    both = rows.join(side, key, "left")
    held = F.filter(F.coalesce("__new", F.array().cast("array<string>")), lambda m: F.contains(F.col("text"), m))
    return both.withColumn("mentions", F.when(F.size("mentions") == 0, held).otherwise(F.col("mentions"))).drop("__new")


def none_rates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of each key, and how many had no mention before (column was_empty) and have none now."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if("was_empty").alias("none_before"), F.count_if(F.size("mentions") == 0).alias("none_after"))


def voice_event_ir(book: Column, segment: Column, span: Column, text: Column, kind: Column) -> Column:
    """An event's id, span offsets and faults."""
    from folio.functions.text import align, hash_of

    at = align(span, text)
    faults = F.array_compact(F.array(F.when(at["status"] == "ABSENT", "SPAN_ABSENT"), F.when(at["status"] == "AMBIGUOUS", "SPAN_AMBIGUOUS"), F.when(~kind.isin("VOICE_OVERRIDE", "PERFORMANCE", "NONE"), "KIND_UNKNOWN")))
    return F.struct(hash_of(book, segment, span, size=16).alias("event_id"), at["start"].alias("start"), at["end"].alias("end"), faults.alias("faults"))


def pronoun_flags(text: Column, before: Column, pronouns: str, names: Column) -> Column:
    """Whether a text has a pronoun, and whether an earlier text names someone it may stand for."""
    has = text.rlike(pronouns)
    return F.struct(has.alias("pronoun"), (has & F.exists(before, lambda t: F.exists(names, lambda n: F.contains(t, n)))).alias("resolvable"))


def prompt(title: Column, sections: list[tuple[str, Column]]) -> Column:
    """A prompt of a title and sections; an array makes one line for each item, and empty sections are left out."""
    parts = [F.when(body != "", F.concat(F.lit(f"[{name}]\n"), body)) for name, body in sections]
    return F.concat_ws("\n\n", title, *parts)


def candidate_list(candidates: Column) -> Column:
    """Numbered candidates, one on each line: C1 name."""
    return F.array_join(F.transform(candidates, lambda c, i: F.concat(F.lit("C"), (i + 1).cast("string"), F.lit(" "), c)), "\n")


#: Behaviours of old records and the observation that each one is.
LEGACY_BEHAVIOURS = {"appear": "MENTION", "speak": "MENTION", "alias": "ALIAS", "disguise": "EMBODIMENT", "possess": "EMBODIMENT", "voice_change": "TEMP_VOICE", "grow": "VOICE_PHASE", "attribute": "ATTRIBUTE"}


def legacy_observation(behaviour: Column, surface: Column, value: Column, position: Column) -> Column:
    """An old behaviour record as an observation; null for behaviours that are none."""
    kind = F.try_element_at(F.create_map(*(F.lit(x) for kv in LEGACY_BEHAVIOURS.items() for x in kv)), F.lower(behaviour))
    return F.when(kind.isNotNull(), F.struct(kind.alias("type"), surface.alias("surface"), value.alias("value"), position.alias("position")))


def pending(cases: DataFrame, done: DataFrame, key: str = "sample_id") -> DataFrame:
    """Cases that a stopped run hasn't answered yet."""
    return cases.join(done.select(key).distinct(), key, "left_anti")


def label_sheet(cases: DataFrame, arms: dict[str, DataFrame], key: str = "sample_id") -> DataFrame:
    """Cases with each arm's answer and validity beside them; a missing answer is null."""
    for name, rows in arms.items():
        cases = cases.join(rows.select(key, F.col("answer").alias(f"{name}_answer"), F.col("valid").alias(f"{name}_valid")), key, "left")
    return cases
