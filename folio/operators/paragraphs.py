"""Logical paragraphs: lines joined across soft wraps, with spans back to the source, and links between neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.functions.text import hash_of, join_separator
from folio.lexicon import LATIN, Lexicon
from folio.operators.blocks import line_class
from folio.operators.layout import any_of


def sessions(lines: DataFrame, boundaries: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``lines`` with seg: a new paragraph begins after every boundary but a soft wrap. Blank lines belong to none."""
    breaks = boundaries.where("boundary_type <> 'SOFT_WRAP'").select(id_col, F.col("next_line").alias("line_no"), F.lit(1).alias("__break"))
    w = W.partitionBy(id_col).orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    live = lines.where(~F.col("is_blank")).join(breaks, [id_col, "line_no"], "left")
    return live.withColumn("seg", F.sum(F.coalesce("__break", F.lit(0))).over(w)).drop("__break")


def build_paragraphs(rows: DataFrame, id_col: str = "doc_id", lex: Lexicon = LATIN) -> DataFrame:
    """One row for each paragraph: id, paragraph_index, from_line, to_line, text, block_type, spans, fingerprint.

    ``rows`` are lines with seg. Bodies lose their indent of ideographic spaces or tabs; the separator depends on the
    characters that meet. A span maps [start, end) of the text to a line's code points; an inserted space has no line.
    Separator and boilerplate paragraphs are left out; the index counts those that stay.
    """
    indent = F.least(F.greatest("lead_full", "lead_tab"), F.length("text"))
    w = W.partitionBy(id_col, "seg").orderBy("line_no")
    before = F.lag("text").over(w)
    parts = rows.withColumn("__indent", indent).withColumn("__body", F.expr("substring(text, __indent + 1)")).withColumn("__sep", F.coalesce(F.when(before.rlike(r"[ \t]$"), "").otherwise(join_separator(before, F.col("text"))), F.lit("")))
    source = F.col("char_start") + F.col("__indent") if "char_start" in rows.columns else F.lit(None).cast("long")
    part = F.struct("line_no", F.col("__sep").alias("sep"), F.col("__body").alias("body"), source.cast("long").alias("source_start"), line_class(F.col("text"), lex).alias("kind"))
    got = parts.groupBy(id_col, "seg").agg(F.sort_array(F.collect_list(part)).alias("p"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,line_no:int,source_start:bigint,synthetic:boolean>>").alias("s"))

    def step(a: Column, x: Column) -> Column:
        sep, body = F.length(x["sep"]), F.length(x["body"])
        space = F.when(sep > 0, F.array(F.struct(a["at"].alias("start"), (a["at"] + sep).alias("end"), F.lit(None).cast("int").alias("line_no"), F.lit(None).cast("long").alias("source_start"), F.lit(True).alias("synthetic")))).otherwise(F.array().cast("array<struct<start:int,end:int,line_no:int,source_start:bigint,synthetic:boolean>>"))
        own = F.array(F.struct((a["at"] + sep).alias("start"), (a["at"] + sep + body).alias("end"), x["line_no"].alias("line_no"), x["source_start"].alias("source_start"), F.lit(False).alias("synthetic")))
        return F.struct((a["at"] + sep + body).alias("at"), F.concat(a["s"], space, own).alias("s"))

    first = F.try_element_at(F.filter("p.kind", lambda k: ~k.isin("PROSE", "UNKNOWN")), F.lit(1))
    out = got.select(
        id_col, "seg", F.element_at("p.line_no", 1).alias("from_line"), F.element_at("p.line_no", -1).alias("to_line"), F.array_join(F.transform("p", lambda x: F.concat(x["sep"], x["body"])), "").alias("text"), F.coalesce(first, F.lit("PROSE")).alias("block_type"), F.aggregate("p", zero, step)["s"].alias("spans"),
    ).where("block_type not in ('SEPARATOR', 'BOILERPLATE')")
    out = out.withColumn("paragraph_index", F.row_number().over(W.partitionBy(id_col).orderBy("seg")) - 1).drop("seg")
    real = F.transform(F.filter("spans", lambda s: ~s["synthetic"]), lambda s: F.concat_ws(":", s["line_no"].cast("string"), s["start"].cast("string"), s["end"].cast("string")))
    return out.withColumn("fingerprint", hash_of(F.col(id_col), F.array_join(real, ";"), F.col("block_type")))


def paragraph_links(paragraphs: DataFrame, id_col: str = "doc_id", lex: Lexicon = LATIN) -> DataFrame:
    """Links of neighbours: a speech cue before a quotation, a quotation that goes on, or mere continuation."""
    w = W.partitionBy(id_col).orderBy("paragraph_index")
    opening, closing = lex.quotes[0] if lex.quotes[0][0] != lex.quotes[0][1] else lex.quotes[-1]
    count = lambda c, x: F.regexp_count(c, F.lit(any_of(x)))
    rows = paragraphs.select(id_col, "paragraph_index", F.trim("text").alias("prev"), F.lead(F.trim("text")).over(w).alias("next")).where("next is not null")
    cue = F.col("prev").rlike(lex.cue_end) & F.left("next", F.lit(1)).isin(*(a for a, _ in lex.quotes))
    spans = (count("prev", opening) > count("prev", closing)) | (count("next", closing) > count("next", opening))
    kind = F.when(cue, "SPEECH_CUE").when(spans, "QUOTE_CONTINUATION").otherwise("CONTINUATION")
    sure = F.when(cue, 0.98).when(spans, 0.9).otherwise(0.6)
    return rows.select(id_col, "paragraph_index", (F.col("paragraph_index") + 1).alias("next_index"), kind.alias("link_type"), sure.alias("link_confidence"))


def chapter_of(rows: DataFrame, chapters: DataFrame, id_col: str = "doc_id", line: str = "from_line") -> DataFrame:
    """``rows`` with the chapter whose closed line interval holds them, or null. Chapters of one document don't overlap.

    A chapter's start and the rows meet in one window over the document (an as-of join), and the end is tested after.
    """
    starts = chapters.select(id_col, F.col("start_line").alias("__at"), F.struct("chapter_id", "end_line").alias("__c"))
    names = rows.columns
    asked = rows.select(id_col, F.col(line).alias("__at"), F.lit(None).cast(starts.schema["__c"].dataType).alias("__c"), F.struct(*names).alias("__row"))
    both = starts.withColumn("__row", F.lit(None).cast(asked.schema["__row"].dataType)).unionByName(asked)
    w = W.partitionBy(id_col).orderBy("__at", F.col("__row").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    got = both.withColumn("__c", F.last("__c", ignorenulls=True).over(w)).where("__row is not null")
    held = F.col("__at") <= F.coalesce("__c.end_line", F.lit(2**31 - 1))
    return got.select(*(F.col(f"__row.{n}").alias(n) for n in names), F.when(held, F.col("__c.chapter_id")).alias("chapter_id"))


def paragraph_filter(text: Column, low: int = 40, high: int = 600, heading: str = r"^(第.{1,9}[章节回卷]|Chapter\s+\d+)") -> Column:
    """Paragraphs of a usable length that aren't headings."""
    return F.length(F.trim(text)).between(low, high) & ~F.trim(text).rlike(heading)
