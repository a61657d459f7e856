"""Voice state: a reducer over control events, its layered engine, and the intervals that a replay leaves."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def temp_key(style: Column, target: Column) -> Column:
    """Identity of an override: its style, else its target, else UNKNOWN."""
    known = lambda c: F.when((c != "") & (c != "UNKNOWN"), c)
    return F.coalesce(known(style), known(target), F.lit("UNKNOWN"))


def reduce_overrides(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``events`` (operation SET or CLEAR, style, target) with temp_key and action.

    The state after an event depends on that event alone: its key after SET, nothing after CLEAR. So the state before
    an event is the lag of that, and no loop is needed.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    rows = events.withColumn("temp_key", F.when(F.col("operation") == "SET", temp_key(F.col("style"), F.col("target"))))
    rows = rows.withColumn("state_before", F.lag("temp_key").over(w))
    before, now = F.col("state_before"), F.col("temp_key")
    action = F.when(now.isNotNull(), F.when(before.isNull(), "START").when(before == now, "CONTINUE").otherwise("REPLACE")).when(before.isNotNull(), "END").otherwise("NONE")
    return rows.withColumn("action", action)


def utterance_boundary(scope: Column, active: Column) -> Column:
    """What the end of an utterance does to an override."""
    return F.when(~active, "NONE").when(scope == "UTTERANCE", "END").otherwise("CONTINUE")


class VoiceEngine:
    """Base voice, phase and one override. An utterance's override ends when the next event arrives, which is used up by that."""

    def __init__(self, base: str | None = None, phase: str | None = None, override: tuple | None = None) -> None:
        self.base, self.phase, self.override = base, phase, override

    def apply(self, kind: str, operation: str | None, style: str | None, target: str | None, scope: str | None) -> str:
        if self.override is not None and self.override[1] == "UTTERANCE":
            self.override = None
            return "END"
        if kind in ("NONE", "PERFORMANCE"):
            return kind
        if operation == "CLEAR":
            had, self.override = self.override, None
            return "ORPHAN_CLEAR" if had is None else "END"
        key = next((x for x in (style, target) if x and x != "UNKNOWN"), "UNKNOWN")
        if self.override is None:
            action = "START"
        elif self.override[0] == key:
            self.override = (key, scope or self.override[1])
            return "CONTINUE"
        else:
            action = "REPLACE"
        self.override = (key, scope or "UNTIL_CLEAR")
        return action

    @property
    def effective(self) -> str | None:
        return self.override[0] if self.override else self.phase or self.base


ENGINE_COLUMNS = ["kind", "operation", "style", "target", "scope"]


def _text(x) -> str | None:
    return x if isinstance(x, str) else None


def run_engine(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Key, order columns, action and override after each event, by replaying each key's events in order (a group map: an expiry uses up an event)."""

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order)
        engine, actions, held = VoiceEngine(), [], []
        for row in part[ENGINE_COLUMNS].itertuples(index=False):
            actions.append(engine.apply(*map(_text, row)))
            held.append(engine.override[0] if engine.override else None)
        out = part[keys + order].copy()
        out["action"], out["override"] = actions, held
        return out

    fields = ", ".join(f"{c} {events.schema[c].dataType.simpleString()}" for c in keys + order)
    return events.select(*keys, *order, *ENGINE_COLUMNS).groupBy(*keys).applyInPandas(walk, f"{fields}, action string, override string")


def timeline(actions: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """Override intervals [start, end) from engine actions: START and REPLACE open one, the next END or REPLACE closes it, the last may stay open. ORPHAN_CLEAR is a point."""
    w = W.partitionBy(*keys).orderBy(at, tie)
    marks = actions.where("action in ('START', 'REPLACE', 'END')").withColumn("end_at", F.lead(at).over(w))
    opened = marks.where("action <> 'END'").select(*keys, F.col(at).alias("start_at"), "end_at", F.lit("OVERRIDE").alias("state_type"), F.col("override").alias("descriptor"))
    orphans = actions.where("action = 'ORPHAN_CLEAR'").select(*keys, F.col(at).alias("start_at"), F.col(at).alias("end_at"), F.lit("ORPHAN_CLEAR").alias("state_type"), F.lit(None).cast("string").alias("descriptor"))
    return opened.unionByName(orphans)


def state_summary(phase: Column, override: Column, embodiment: Column) -> Column:
    """One string of what holds, in a fixed order; null if nothing does."""
    text = F.concat_ws(";", F.when(phase.isNotNull(), F.concat(F.lit("phase="), phase)), F.when(override.isNotNull(), F.concat(F.lit("override="), override)), F.when(embodiment.isNotNull(), F.concat(F.lit("body="), embodiment)))
    return F.nullif(text, F.lit(""))


def recover_speakers(rows: DataFrame, keys: list[str], order: str, back: int = 5) -> DataFrame:
    """keys, order, speaker and how: null speakers take the last speaker of the key, recovered ones included, unless a row resets; else the most frequent mention of the ``back`` rows before, the smallest of equals.

    ``rows`` has speaker, reset (boolean) and mentions (array); null resets are none, null and empty mentions count for nothing, and an
    empty speaker stays but is nobody's last. What is recovered feeds back, yet between two resets only the first mention that fills a
    gap before any speaker does, so windows state it: the last speaker given, else the first such mention. Positions of a key are distinct.
    """
    over = W.partitionBy(*keys).orderBy(order)
    recent = F.flatten(F.collect_list(F.filter(F.coalesce("mentions", F.array().cast("array<string>")), lambda m: m != "")).over(over.rowsBetween(-back, -1)))
    marked = rows.select(*keys, order, "speaker", recent.alias("__recent"), F.sum(F.coalesce(F.col("reset"), F.lit(False)).cast("int")).over(over.rowsBetween(W.unboundedPreceding, 0)).alias("__episode"))
    counts = F.transform(F.array_distinct("__recent"), lambda m: F.struct((-F.size(F.filter("__recent", lambda x: x == m))).alias("n"), m.alias("m")))
    marked = marked.withColumn("__mode", F.array_min(counts)["m"])
    before = W.partitionBy(*keys, "__episode").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    given = F.last(F.nullif("speaker", F.lit("")), ignorenulls=True).over(before)
    filled = F.first(F.when(F.col("speaker").isNull(), F.col("__mode")), ignorenulls=True).over(before)
    marked = marked.withColumn("__last", F.coalesce(given, filled))
    how = F.when(F.col("speaker").isNotNull(), "GIVEN").when(F.col("__last").isNotNull(), "LAST").when(F.col("__mode").isNotNull(), "MODE").otherwise("NONE")
    return marked.select(*keys, order, F.coalesce("speaker", "__last", "__mode").alias("speaker"), how.alias("how"))


def layered_resolver(rows: DataFrame, aliases: DataFrame, blacklist: list[str]) -> DataFrame:
    """Row-local layers: the speaker's alias, the first mention with an alias, null for a role word, the speaker, the only mention that is no role word.

    ``rows`` has speaker and mentions; ``aliases`` (surface, canonical) is a small table that is gathered as a map of a checked size.
    """
    if aliases.limit(50_001).count() > 50_000:
        raise ValueError("more than 50000 aliases; join them by surface instead")
    table = aliases.agg(F.map_from_entries(F.collect_list(F.struct("surface", "canonical"))).alias("__a"))
    both = rows.crossJoin(F.broadcast(table))
    role = lambda c: c.isin(*blacklist)
    named = F.filter(F.transform("mentions", lambda m: F.try_element_at(F.col("__a"), m)), lambda x: x.isNotNull())
    plain = F.filter("mentions", lambda m: ~role(m))
    only = F.when(F.size(plain) == 1, F.try_element_at(plain, F.lit(1)))
    resolved = F.coalesce(F.try_element_at("__a", F.col("speaker")), F.try_element_at(named, F.lit(1)), F.when(~role(F.col("speaker")), F.col("speaker")), F.when(F.col("speaker").isNull(), only))
    return both.withColumn("resolved", resolved).drop("__a")
