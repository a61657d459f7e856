"""The mention lexicon: who is called, introduced or cued in a text, how sure that is, and what it binds to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.closed_classes import (
    BLOCK_HEADS, BLOCK_TAILS, GAZE_ENDS, GAZES, GROUP_CHARS, IMITATED, INTRODUCTIONS, LEXICON_VERBS, MACHINE_CHARS, MENTION_WEIGHTS, NAME_PREFIXES, NAME_SUFFIXES, NO_CALL, OWN_AGAIN, OWN_VOICE, PERCEIVED, ROLE_CHARS,
)
from folio.functions.text import let

NAME = "^[一-龥]{2,4}$"
BREAKS = r"[，。！？；：、\s“”\"《》]"
ZONE = 40
STRINGS = "array<string>"


def _none() -> Column:
    return F.array().cast(STRINGS)


def _heads(text: Column, name: str = NAME) -> Column:
    """The first four, three and two characters of a text, where these may be a name."""
    return F.filter(F.array(*(F.left(text, F.lit(n)) for n in (4, 3, 2))), lambda x: x.rlike(name))


def called(text: Column, name: str = "[一-龥]{2,4}", no_call: list[str] = NO_CALL) -> Column:
    """array<string>: the name that a speech begins by calling, if any."""
    t = F.regexp_replace(F.trim(text), "^[“‘「『\"]+", "")
    found = F.regexp_extract(t, rf"^({name})[，,！!？?。.；;：:、\s]", 1)
    return F.when((found != "") & ~F.left(found, F.lit(1)).isin(*no_call), F.array(found)).otherwise(_none())


def introduced(text: Column, words: list[str] = INTRODUCTIONS, name: str = "[一-龥]{2,4}") -> Column:
    """array<string>: the names by which speakers introduce themselves."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(f"(?:{'|'.join(words)})({name})"), F.lit(1)), _none())


def _of_block(block: Column) -> Column:
    """All that may be a name in one block before a cue's verb: the bare block, its first characters, what follows its last attribute, and names beside titles."""
    gazer = F.regexp_extract(block, f"^(.*?)(?:{'|'.join(GAZES)})(?:.{{0,6}}?)(?:{'|'.join(GAZE_ENDS)})?$", 1)
    own = let(gazer, lambda g: F.when(g != "", g).otherwise(block))
    bare = F.regexp_replace(F.regexp_replace(own, f"^(?:{'|'.join(BLOCK_HEADS)})+", ""), f"[{BLOCK_TAILS}]+$", "")
    whole = lambda x: F.when(x.rlike(NAME), F.array(x)).when(F.length(x) > 4, _heads(x)).otherwise(_none())
    first = lambda words, fits: F.get(F.filter(F.array(*map(F.lit, words)), fits), F.lit(0))

    def of(b: Column) -> Column:
        after = F.when(F.contains(b, F.lit("的")), let(F.element_at(F.split(b, "的", -1), -1), whole)).otherwise(_none())
        suffix = first(NAME_SUFFIXES, lambda w: F.endswith(b, w) & (F.length(b) > F.length(w)))
        base = let(F.left(b, F.length(b) - F.length(suffix)), lambda x: F.when(x.rlike(NAME), F.array(x)).otherwise(_none()))
        prefix = first(NAME_PREFIXES, lambda w: F.startswith(b, w) & (F.length(b) > F.length(w)))
        rest = let(F.substring(b, F.length(prefix) + 1, F.lit(100)), lambda x: F.when(x.isNotNull(), _heads(x)).otherwise(_none()))
        return F.concat(whole(b), after, base, rest)

    return let(bare, of)


def cue_subjects(text: Column) -> Column:
    """array<string>: all that may be the subject of a cue in a text, with repeats.

    Before each verb of saying a zone goes back to the sentence's start, ``ZONE`` characters at most, and is cut into
    blocks at punctuation.
    """
    verbs = "|".join(LEXICON_VERBS)
    found = F.coalesce(F.regexp_extract_all(text, F.lit(f"(?s)((?:(?!{verbs}).)*(?:{verbs}))"), F.lit(1)), _none())
    ends = F.transform(found, lambda x, k: F.array_join(F.slice(found, F.lit(1), k + 1), ""))
    zones = F.transform(ends, lambda x: F.regexp_extract(F.regexp_replace(x, f"(?:{verbs})$", ""), f"([^。！？…；]{{0,{ZONE}}})$", 1))
    blocks = F.filter(F.transform(F.flatten(F.transform(zones, lambda z: F.split(z, BREAKS))), lambda b: F.trim(b)), lambda b: b != "")
    return F.flatten(F.transform(blocks, _of_block))


def mention_rows(segments: DataFrame, keys: list[str], order: str, text: str = "text", context: str = "context", kinds: list[tuple[str, Column]] | None = None) -> DataFrame:
    """keys, order, surface, kind: a row for each mention in a segment's speech (vocative, self_intro) and in its context (cue), or of the given ``kinds``."""
    kinds = kinds or [("vocative", called(F.col(text))), ("self_intro", introduced(F.col(text))), ("cue", cue_subjects(F.col(context)))]
    named = lambda kind: lambda s: F.struct(s.alias("surface"), F.lit(kind).alias("kind"))
    every = F.concat(*(F.transform(F.coalesce(found, _none()), named(kind)) for kind, found in kinds))
    return segments.select(*keys, order, F.explode(every).alias("__m")).select(*keys, order, "__m.surface", "__m.kind")


def mention_lexicon(mentions: DataFrame, keys: list[str], order: str, bucket: str) -> DataFrame:
    """keys, surface, counts by kind and in all, n_buckets, first and last place, confidence: weighted counts, each capped, and 3 more from three buckets on."""
    kinds = ["vocative", "self_intro", "cue", "narrative"]
    rows = mentions.groupBy(*keys, "surface").agg(F.count("*").alias("total"), *(F.count_if(F.col("kind") == k).alias(k) for k in kinds), F.count_distinct(bucket).alias("n_buckets"), F.min(order).alias("first"), F.max(order).alias("last"))
    parts = [F.least(F.col(k), F.lit(cap)) * w if cap else F.col(k) * w for k, (w, cap) in MENTION_WEIGHTS.items()]
    return rows.withColumn("confidence", F.round(sum(parts, F.lit(0.0)) + F.when(F.col("n_buckets") >= 3, 3).otherwise(0), 1))


def mention_class(mentions: Column, text: Column) -> Column:
    """One of nine classes of a sample by its mentions and its text."""
    first, n = F.get(mentions, F.lit(0)), F.coalesce(F.size(mentions), F.lit(0))
    return (
        F.when(n <= 0, "NONE").when(n >= 3, "multi_person").when(first.rlike(r"[\x00-\x7F]"), "foreign_name").when(F.length(first) >= 6, "long_name").when(first.rlike(f"[{ROLE_CHARS}]"), "role_title")
        .when(first.rlike(f"[{GROUP_CHARS}]"), "group").when(first.rlike(f"[{MACHINE_CHARS}]"), "nonhuman").when(text.rlike("我是|我叫|在下"), "first_appearance").otherwise("chinese_name")
    )


def head_mentions(contexts: Column, entities: Column, name: str = NAME, breaks: str = BREAKS) -> Column:
    """array<string>, sorted: the entities that blocks of earlier texts are, or, of blocks longer than four, that they begin with: the longest of four, three or two characters."""
    blocks = F.filter(F.transform(F.flatten(F.transform(F.coalesce(contexts, _none()), lambda t: F.split(t, breaks))), lambda b: F.trim(b)), lambda b: b != "")
    known = lambda x: F.array_contains(entities, x)
    best = lambda b: F.when(b.rlike(name), F.when(known(b), b)).when(F.length(b) > 4, F.get(F.filter(_heads(b, name), known), F.lit(0)))
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(blocks, best))))


def candidate_store(cues: Column, mentions: Column, recent: Column, scene: Column, entities: Column) -> Column:
    """array<struct<surface, source>>: candidates of five sources in order, each surface once: cues, mentions that are entities, recent mentions, who is in the scene, and mentions that are no entities."""
    known = lambda m: F.array_contains(entities, m)
    given = [("CUE", cues), ("AI_MENTION", F.filter(mentions, known)), ("RECENT_MENTION", recent), ("SCENE_ACTIVE", scene), ("NEW_MENTION", F.filter(mentions, lambda m: ~known(m)))]
    named = lambda source: lambda x: F.struct(x.alias("surface"), F.lit(source).alias("source"))
    every = F.concat(*(F.transform(F.filter(F.coalesce(c, _none()), lambda x: x.isNotNull() & (x != "")), named(source)) for source, c in given))
    return let(every, lambda rows: F.filter(rows, lambda r, i: ~F.exists(F.slice(rows, F.lit(1), i), lambda before: before["surface"] == r["surface"])))


def _role_of(surface: Column, candidates: Column) -> Column:
    """The role of the first candidate whose name is or holds the surface, else of the shortest name that the surface begins with, or that begins with it."""
    held = F.get(F.filter(candidates, lambda c: F.contains(c["name"], surface)), F.lit(0))["role"]
    near = F.transform(F.filter(candidates, lambda c: (c["name"] != "") & (F.startswith(c["name"], surface) | F.startswith(surface, c["name"]))), lambda c, i: F.struct(F.length(c["name"]).alias("n"), i.alias("i"), c["role"].alias("role")))
    return F.when(surface != "", F.coalesce(held, F.array_min(near)["role"]))


def sure_binding(kind: Column, text: Column, candidates: Column) -> Column:
    """struct<owner, reference, status, span> of a voice event by patterns that leave no doubt; UNKNOWN and PENDING by any other text.

    ``candidates`` is an array of (role, name). The first that holds: someone's voice changes; someone imitates a
    candidate's voice, on setting; someone gets their own voice back, on clearing.
    """
    at = lambda p, g: F.regexp_extract(text, p, g)
    out = lambda owner, reference, status, span: F.struct(owner.alias("owner"), reference.alias("reference"), status.alias("status"), span.alias("span"))
    owner = _role_of(F.when(~at(OWN_VOICE, 1).rlike(PERCEIVED), at(OWN_VOICE, 1)), candidates)
    actor, target, again = _role_of(at(IMITATED, 1), candidates), _role_of(at(IMITATED, 2), candidates), _role_of(at(OWN_AGAIN, 1), candidates)
    word = F.lit
    return (
        F.when(kind.isin("VOICE_OVERRIDE_SET", "VOICE_OVERRIDE_CLEAR", "PERFORMANCE") & owner.isNotNull(), out(owner, word("NONE"), word("BOUND"), at(OWN_VOICE, 0)))
        .when((kind == "VOICE_OVERRIDE_SET") & target.isNotNull(), out(F.coalesce(actor, word("UNKNOWN")), target, F.when(actor.isNotNull(), "BOUND").otherwise("PENDING"), at(IMITATED, 0)))
        .when((kind == "VOICE_OVERRIDE_CLEAR") & again.isNotNull(), out(again, word("NONE"), word("BOUND"), at(OWN_AGAIN, 0)))
        .otherwise(out(word("UNKNOWN"), word("UNKNOWN"), word("PENDING"), word(None).cast("string")))
    )
