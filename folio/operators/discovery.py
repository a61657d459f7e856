"""Who speaks in a text: names harvested from cues, sifted by what the text says of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.checkpoints import cut
from folio.operators.names import gate, name_variants, surface_evidence
from folio.operators.segments import NAME, VERBS, cue_columns, explode_segments


def harvest(segments: DataFrame, keys: list[str], index: str, known: str | None = None, verbs: str = VERBS, name: str = NAME) -> DataFrame:
    """keys, surface: the distinct names that cues give the quotations of each key, without particles before them."""
    cued = cue_columns(segments, keys, index, known, verbs, name).where("type <> 'NARRATION'")
    named = cued.select(*keys, F.coalesce("inline_cue", "post_cue", "cross_cue").alias("named")).where("named is not null")
    return named.select(*keys, F.explode(name_variants(F.col("named"))).alias("surface")).distinct()


def discover(paragraphs: DataFrame, keys: list[str], index: str, quotes: tuple[tuple[str, str], ...], text_col: str = "text", verbs: str = VERBS, name: str = NAME) -> DataFrame:
    """keys, surface, corpus counts, reject (null: a name) and residue_of, in three steps.

    Cues are read without known names; the gate sifts what they give by closed classes and by counts in the key's own
    texts; with the names so accepted cues are read again, and all that was found passes the gate once more. The names
    of one key, a book, stand in one row; nothing comes to the driver but the lengths of surfaces.
    """
    texts = paragraphs.select(*keys, F.col(text_col).alias("text"))
    segments = cut(explode_segments(paragraphs, keys, index, quotes, text_col))
    raw = cut(harvest(segments, keys, index, None, verbs, name))
    sifted = gate(surface_evidence(texts, raw, keys=keys), keys=keys)
    known = sifted.where("reject is null").groupBy(*keys).agg(F.array_sort(F.collect_set("surface")).alias("known"))
    again = harvest(segments.join(known, keys, "left"), keys, index, "known", verbs, name)
    found = cut(raw.unionByName(again).distinct())
    return gate(surface_evidence(texts, found, keys=keys), keys=keys)
