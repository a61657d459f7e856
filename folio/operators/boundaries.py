"""Boundaries between neighbouring lines: features, scores and the decision to join or to break."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.lexicon import LATIN, Lexicon
from folio.operators.layout import any_of, one_of
from folio.operators.lines import last_char

#: Bits of the evidence mask, by name.
EVIDENCE = ["STRUCTURAL_ANCHOR", "SPECIAL_BLOCK_GROUP", "SPECIAL_BLOCK_GROUP_EXIT", "BLANK_GAP", "FIXED_WIDTH_PROFILE", "PREV_AT_WRAP_WIDTH", "PREV_NO_TERMINAL", "PREV_ENDS_COMMA", "PREV_ENDS_SEMICOLON", "PREV_TERMINAL", "QUOTE_CONTINUES", "NEXT_STRONG_INDENT", "NEXT_QUOTE_INDENTED", "SPEECH_CUE_KEEP"]


def quote_depths(lines: DataFrame, id_col: str = "doc_id", lex: Lexicon = LATIN) -> DataFrame:
    """id, line_no, depth_before, depth_after by a typed stack over a document's lines.

    An opening mark that repeats the top of the stack closes it, as a mark that opens and closes alike does. Only lines
    with marks matter, and only their marks go through the group map; other lines take the last depth by a window.
    """
    opening, closing = {a for a, _ in lex.quotes}, {b for _, b in lex.quotes}
    cls = any_of("".join(sorted(opening | closing)))
    marks = F.array_join(F.regexp_extract_all("text", F.lit(f"({cls})"), F.lit(1)), "")
    rows = lines.select(id_col, "line_no", marks.alias("marks"))

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("line_no")
        stack: list[str] = []
        after = []
        for line in part.marks:
            for c in line:
                if c in opening:
                    stack.pop() if stack and stack[-1] == c else stack.append(c)
                elif stack:
                    stack.pop()
            after.append(len(stack))
        return pd.DataFrame({id_col: part[id_col], "line_no": part.line_no, "depth_after": after})

    kind = lines.schema[id_col].dataType.simpleString()
    walked = rows.where("marks <> ''").groupBy(id_col).applyInPandas(walk, f"{id_col} {kind}, line_no int, depth_after int")
    w = W.partitionBy(id_col).orderBy("line_no")
    both = rows.drop("marks").join(walked, [id_col, "line_no"], "left").withColumn("depth_after", F.coalesce(F.last("depth_after", ignorenulls=True).over(w), F.lit(0)))
    return both.withColumn("depth_before", F.coalesce(F.lag("depth_after").over(w), F.lit(0)))


def boundary_features(lines: DataFrame, id_col: str = "doc_id", lex: Lexicon = LATIN) -> DataFrame:
    """A row for each pair of neighbouring lines that aren't blank, keyed by the left line; needs depth_after, in_group and mode_len."""
    w = W.partitionBy(id_col).orderBy("line_no")
    live = lines.where(~F.col("is_blank"))
    nxt = lambda c: F.lead(c).over(w)
    rows = live.select(
        id_col, "line_no", F.col("text").alias("prev_text"), nxt("text").alias("next_text"), nxt("line_no").alias("next_line"), F.col("char_count").alias("prev_len"), nxt("char_count").alias("next_len"),
        F.col("lead_full").alias("prev_indent"), nxt("lead_full").alias("next_indent"), F.col("depth_after").alias("depth_before"), nxt("depth_after").alias("depth_after"), F.col("in_group").alias("prev_group"), nxt("in_group").alias("next_group"), F.col("mode_len"),
    ).where("next_line is not null")
    last, first = last_char(F.col("prev_text")), F.left("next_text", F.lit(1))
    ends = lex.terminal + "".join(b for _, b in lex.quotes)
    near = lambda c: (F.col("mode_len") > 0) & (F.abs(F.col(c) - F.col("mode_len")) <= 2)
    return rows.withColumns({
        "blank_between": F.col("next_line") > F.col("line_no") + 1, "prev_terminal": one_of(last, ends), "prev_colon": one_of(last, lex.colon), "prev_comma": one_of(last, lex.comma), "prev_semicolon": one_of(last, lex.semicolon),
        "next_quote": first.isin(*(a for a, _ in lex.quotes)), "prev_cue": F.col("prev_text").rlike(lex.cue_end), "prev_wrap": near("prev_len"), "next_wrap": near("next_len"),
    })


def decide(rows: DataFrame, profile_type: str = "profile_type", full_indent: str = "full_indent", structural: str | None = None) -> DataFrame:
    """``rows`` with boundary_type, boundary_confidence, evidence (names) and evidence_mask (bits of ``EVIDENCE``)."""
    c = F.col
    score = [
        ("FIXED_WIDTH_PROFILE", c(profile_type) == "FIXED_WIDTH_HARD_WRAP", 2.0), ("PREV_AT_WRAP_WIDTH", c("prev_wrap"), 1.2), ("PREV_NO_TERMINAL", ~c("prev_terminal") & ~c("prev_colon"), 1.4), ("PREV_ENDS_COMMA", c("prev_comma"), 1.0), ("PREV_ENDS_SEMICOLON", c("prev_semicolon"), 0.5),
        ("PREV_TERMINAL", c("prev_terminal"), -1.0), ("QUOTE_CONTINUES", (c("depth_before") > 0) | (c("depth_after") > 0), 0.8), ("NEXT_STRONG_INDENT", (c("next_indent") >= 2) & c(full_indent).between(0.3, 0.95), -2.5), ("NEXT_QUOTE_INDENTED", c("next_quote") & (c("next_indent") >= 2), -1.8),
    ]
    diff = sum((F.when(cond, F.lit(x)).otherwise(0.0) for _, cond, x in score), F.lit(0.0))
    scored = F.array_compact(F.array(*(F.when(cond, F.lit(name)) for name, cond, _ in score)))
    keep = c("next_quote") & (c("prev_colon") | c("prev_cue"))
    rows = rows.withColumn("score", F.round(diff, 6))
    anchor = c(structural) if structural else F.lit(False)
    size = F.abs("score")
    early = [(anchor, "STRUCTURAL_BREAK", F.lit(1.0), "STRUCTURAL_ANCHOR"), (c("next_group"), "AUTHOR_LINE_BREAK", F.lit(0.92), "SPECIAL_BLOCK_GROUP"), (c("prev_group"), "AUTHOR_LINE_BREAK", F.lit(0.92), "SPECIAL_BLOCK_GROUP_EXIT"), (c("blank_between"), "HARD_PARAGRAPH", F.when(c(profile_type) == "BLANK_LINE_PARAGRAPH", 0.97).otherwise(0.85), "BLANK_GAP")]

    def ladder(pick, rest: Column) -> Column:
        out = None
        for row in early:
            out = F.when(row[0], pick(row)) if out is None else out.when(row[0], pick(row))
        return out.otherwise(rest)

    kind = ladder(lambda r: F.lit(r[1]), F.when(keep, "HARD_PARAGRAPH").when(c("score") >= 0.5, "SOFT_WRAP").when(c("score") <= -0.5, "HARD_PARAGRAPH").otherwise("UNCERTAIN"))
    sure = ladder(lambda r: r[2], F.when(keep, 0.95).when(size >= 3, 0.99).when(size >= 2, 0.92).when(size >= 1, 0.82).otherwise(0.6))
    why = ladder(lambda r: F.array(F.lit(r[3])), F.when(keep, F.concat(scored, F.array(F.lit("SPEECH_CUE_KEEP")))).otherwise(scored))
    mask = F.aggregate("evidence", F.lit(0).cast("long"), lambda a, e: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), (F.array_position(F.array(*map(F.lit, EVIDENCE)), e) - 1).cast("int"))))
    return rows.withColumns({"boundary_type": kind, "boundary_confidence": sure, "evidence": why}).withColumn("evidence_mask", mask)
