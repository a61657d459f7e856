"""Render planning: instructions, units, routes, cache keys, and the job queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.functions.text import backoff_ms, hash_of, java_float

# Phrases of the instruction by decision field and value.
PHRASES = {
    "emotion": {"NEUTRAL": "neutral", "SAD": "sad", "ANGRY": "angry", "JOYFUL": "joyful", "FEARFUL": "fearful", "CALM": "calm", "COLD": "cold", "GENTLE": "gentle"},
    "pace": {"SLOW": "slowly", "FAST": "fast"},
    "volume": {"QUIET": "quietly", "LOUD": "loudly"},
    "tone": {"WARM": "in a warm tone", "SERIOUS": "in a serious tone", "WEARY": "in a weary tone"},
}


def compile_instruction(columns: dict[str, Column], intensity: Column) -> Column:
    """A struct: instruction text, keys without a phrase, and mode (PLAIN without any phrase).

    The emotion is graded by its intensity: from 0.7 very, below 0.3 slightly.
    """
    table = {k: F.create_map(*(F.lit(x) for kv in v.items() for x in kv)) for k, v in PHRASES.items()}
    phrase = {k: F.try_element_at(table[k], c) for k, c in columns.items()}
    if "emotion" in phrase:
        grade = F.when(intensity >= 0.7, "very ").when(intensity < 0.3, "slightly ").otherwise("")
        phrase["emotion"] = F.when(columns["emotion"] == "NEUTRAL", F.lit(None)).otherwise(F.concat(grade, phrase["emotion"]))
    text = F.concat_ws(", ", *phrase.values())
    neutral = ["NORMAL", "NEUTRAL"]
    unknown = F.array_compact(F.array(*(F.when(c.isNotNull() & F.try_element_at(table[k], c).isNull() & ~c.isin(*neutral), F.concat(F.lit(f"{k}="), c)) for k, c in columns.items())))
    return F.struct(text.alias("instruction"), unknown.alias("unknown_keys"), F.when(text == "", "PLAIN").otherwise("INSTRUCTED").alias("mode"))


def unit_violations(longest: int = 400) -> Column:
    """All rules that a render unit breaks; a unit with none may be planned."""
    c = F.col
    rules = {
        "UNIT_ID_MISSING": F.coalesce(c("unit_id"), F.lit("")) == "", "TEXT_MISSING": c("text").isNull(), "TEXT_BLANK": F.trim("text") == "", "TEXT_TOO_LONG": F.length("text") > longest, "VOICE_MISSING": F.coalesce(c("voice_id"), F.lit("")) == "", "SPEED_RANGE": c("speed").isNull() | ~c("speed").between(0.5, 2.0),
        "ORDINAL_NEGATIVE": c("ordinal") < 0, "SPEAKER_MISSING": c("speaker").isNull(), "SPAN_INVERTED": c("span_end") < c("span_start"), "SPAN_LENGTH": (c("span_end") - c("span_start")) != F.length("text"), "MODE_UNKNOWN": ~c("mode").isin("PLAIN", "INSTRUCTED"), "INSTRUCTION_MISSING": (c("mode") == "INSTRUCTED") & (F.coalesce(c("instruction"), F.lit("")) == ""),
    }
    return F.array_compact(F.array(*(F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in rules.items())))


def cache_key(text: Column, voice: Column, speed: Column, instruction: Column, version: str) -> Column:
    """Key of a rendering: the hash of its text nested in the hash of all that shapes the sound; the speed as Java prints a float."""
    return hash_of(hash_of(text, size=64), voice, java_float(speed), F.coalesce(instruction, F.lit("")), F.lit(version))


def speech_route(units: DataFrame, engines: DataFrame) -> DataFrame:
    """``units`` with route: the wanted engine if it is available, else the first fallback that is, else ``unavailable``.

    ``engines`` has engine and available; units have wanted and fallbacks (array).
    """
    up = engines.where("available").agg(F.collect_set("engine").alias("__up"))
    both = units.crossJoin(F.broadcast(up))
    first = F.try_element_at(F.filter(F.concat(F.array("wanted"), F.coalesce("fallbacks", F.array().cast("array<string>"))), lambda e: F.array_contains("__up", e)), F.lit(1))
    return both.withColumn("route", F.coalesce(first, F.lit("unavailable"))).drop("__up")


def plan_units(units: DataFrame, jobs: DataFrame, assets: DataFrame, key: str = "unit_id") -> DataFrame:
    """What to do with each unit: CACHED if an asset has its key, STALE if its job has another, KEEP if the job is the same, PLANNED if new."""
    old = jobs.groupBy(key).agg(F.max_by("cache_key", "updated_at").alias("__old"))
    done = assets.select(key, "cache_key").distinct().withColumn("__done", F.lit(True))
    rows = units.join(old, key, "left").join(done, [key, "cache_key"], "left")
    action = F.when(F.col("__done"), "CACHED").when(F.col("__old").isNull(), "PLANNED").when(F.col("__old") != F.col("cache_key"), "STALE").otherwise("KEEP")
    return rows.withColumn("action", action).drop("__old", "__done")


def claim(jobs: DataFrame, now: Column, per: list[str], n: int = 1, states: tuple[str, ...] = ("PLANNED", "RETRY")) -> DataFrame:
    """The next ``n`` jobs of each renderer: claimable, due, by priority, then age, then id."""
    w = W.partitionBy(*per).orderBy("priority", "updated_at", "job_id")
    due = jobs.where(F.col("state").isin(*states) & (F.coalesce("not_before", F.lit(0)) <= now))
    return due.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn").withColumn("state", F.lit("RUNNING"))


def fail_jobs(jobs: DataFrame, now: Column, base_ms: int = 1000, max_attempts: int = 5) -> DataFrame:
    """Failed jobs with one more attempt: RETRY after a doubling wait, or FAILED when attempts are used up."""
    rows = jobs.withColumn("attempts", F.col("attempts") + 1)
    spent = F.col("attempts") >= max_attempts
    return rows.withColumn("state", F.when(spent, "FAILED").otherwise("RETRY")).withColumn("not_before", F.when(~spent, now + backoff_ms(F.lit(base_ms), F.col("attempts"))))


def complete_jobs(jobs: DataFrame, assets: DataFrame, finished: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(jobs, assets) after some jobs finish: their state is DONE, and of a unit's assets the newest version stays."""
    done = finished.select("job_id", F.lit("DONE").alias("__s"))
    after = jobs.join(done, "job_id", "left").withColumn("state", F.coalesce("__s", "state")).drop("__s")
    w = W.partitionBy("unit_id").orderBy(F.col("version").desc())
    every = assets.unionByName(finished.select(*assets.columns))
    return after, every.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def mark_state(jobs: DataFrame, ids: DataFrame, state: str, only: list[str] | None = None) -> DataFrame:
    """Jobs named in ``ids`` (and in one of the states ``only``) get a state; the rest stay."""
    rows = jobs.join(ids.select("job_id", F.lit(True).alias("__hit")).distinct(), "job_id", "left")
    hit = F.coalesce("__hit", F.lit(False)) & (F.col("state").isin(*only) if only else F.lit(True))
    return rows.withColumn("state", F.when(hit, state).otherwise(F.col("state"))).drop("__hit")


def assets_in_order(asked: DataFrame, assets: DataFrame) -> DataFrame:
    """Assets in the caller's order (ordinal); misses are left out."""
    return asked.join(assets, "unit_id").orderBy("ordinal")
