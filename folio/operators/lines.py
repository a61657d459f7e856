"""Physical lines of a text: rows with character and byte spans, indents and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BREAK = r"\r\n|\r|\n"


def han_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\p{IsHan}"))


def last_char(c: Column) -> Column:
    return F.right(c, F.lit(1))


def is_blank(c: Column) -> Column:
    return ~c.rlike(r"[^\s\x{3000}\x{85}\x{A0}]")


def physical_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spans: bool = True) -> DataFrame:
    """A row for each line: id, line_no from 1, text, counters and, with ``spans``, positions.

    LF, CRLF and CR end a line; a last line without a break is kept and an empty text has none. ``char_start`` and
    ``char_end`` count code points without breaks, ``byte_start`` and ``byte_end`` UTF-8 bytes with them.
    """
    text = F.col(text_col)
    parts = F.arrays_zip(F.split(text, BREAK, -1).alias("text"), F.regexp_extract_all(text, F.lit(f"({BREAK})"), F.lit(1)).alias("brk"))
    rows = docs.select(F.col(id_col), F.posexplode(parts).alias("i", "x"))
    rows = rows.select(id_col, (F.col("i") + 1).alias("line_no"), F.col("x.text").alias("text"), F.col("x.brk").alias("brk"))
    rows = rows.where((F.col("text") != "") | F.col("brk").isNotNull())
    lead = F.regexp_extract("text", r"^[ \t\x{3000}]*", 0)
    count = lambda c, what: F.length(F.regexp_replace(c, f"[^{what}]", ""))
    rows = rows.select(
        id_col, "line_no", "text", F.length("text").alias("char_count"), han_count(F.col("text")).alias("han_count"),
        count(lead, " ").alias("lead_space"), count(lead, r"\x{3000}").alias("lead_full"), count(lead, r"\t").alias("lead_tab"),
        (F.length("text") - F.length(F.rtrim("text"))).alias("trailing_space"), is_blank(F.col("text")).alias("is_blank"),
        F.when(F.col("brk").isNull(), "NONE").when(F.col("brk") == "\n", "LF").when(F.col("brk") == "\r", "CR").otherwise("CRLF").alias("newline"),
        (F.octet_length("text")).alias("bytes"), F.coalesce(F.octet_length("brk"), F.lit(0)).alias("brk_bytes"),
    )
    if not spans:
        return rows.drop("bytes", "brk_bytes")
    before = W.partitionBy(id_col).orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum("char_count").over(before), F.lit(0))
    byte = F.coalesce(F.sum(F.col("bytes") + F.col("brk_bytes")).over(before), F.lit(0))
    rows = rows.withColumns({"char_start": start, "byte_start": byte})
    return rows.withColumns({"char_end": F.col("char_start") + F.col("char_count"), "byte_end": F.col("byte_start") + F.col("bytes")}).drop("bytes", "brk_bytes")


def lines_without_text(lines: DataFrame) -> DataFrame:
    """What a store of offsets keeps."""
    return lines.drop("text")


def read_lines(offsets: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Line texts decoded on demand from byte spans: the asked spans of a document meet its text once, and are cut out of it there."""
    asked = offsets.groupBy(id_col).agg(F.collect_list(F.struct(*(c for c in offsets.columns if c != id_col))).alias("__asked"))
    both = asked.join(docs.select(id_col, F.col(text_col).cast("binary").alias("__raw")), id_col)
    cut_out = lambda s: F.substring(F.col("__raw"), s["byte_start"].cast("int") + 1, (s["byte_end"] - s["byte_start"]).cast("int")).cast("string")
    texts = F.transform("__asked", lambda s: F.struct(s.alias("s"), cut_out(s).alias("text")))
    rows = both.select(id_col, F.explode(texts).alias("__r"))
    return rows.select(*(F.col(c) if c == id_col else F.col(f"__r.s.{c}").alias(c) for c in offsets.columns), "__r.text")


def not_text(c: Column) -> Column:
    """Binary content: more control characters than a sixteenth of the bytes."""
    return F.regexp_count(c, F.lit(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")) > F.octet_length(c) / 16


def line_at(offsets: DataFrame, lines: DataFrame, id_col: str = "doc_id", at: str = "offset") -> DataFrame:
    """The line that holds a character offset: an as-of join by union and last value, so no range join is made."""
    here = lines.select(id_col, F.col("char_start").alias("__at"), F.struct("line_no", "char_start", "char_end").alias("__line"), F.lit(None).cast("long").alias("__ask"))
    asked = offsets.select(id_col, F.col(at).cast("long").alias("__at"), F.lit(None).cast(here.schema["__line"].dataType).alias("__line"), F.col(at).cast("long").alias("__ask"))
    w = W.partitionBy(id_col).orderBy("__at", F.col("__ask").isNotNull(), F.col("__line.line_no")).rowsBetween(W.unboundedPreceding, 0)
    out = here.unionByName(asked).withColumn("__line", F.last("__line", ignorenulls=True).over(w)).where("__ask is not null")
    held = (F.col("__ask") >= F.col("__line.char_start")) & (F.col("__ask") < F.col("__line.char_end"))
    return out.select(id_col, F.col("__ask").alias(at), F.when(held, F.col("__line.line_no")).alias("line_no"))
