"""Block classes of single lines, and runs of lines of one class."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.lexicon import LATIN, Lexicon
from folio.operators.layout import any_of, one_of
from folio.operators.lines import last_char

RUNS = {"SCRIPT": 2, "MESSAGE_LOG": 1, "LIST": 2}


def line_class(text: Column, lex: Lexicon = LATIN) -> Column:
    """The block class by the line alone; the first test that holds decides."""
    t = F.trim(text)
    out = F.when(t == "", "UNKNOWN").when(t.rlike(lex.separator), "SEPARATOR").when(t.rlike(lex.boilerplate), "BOILERPLATE").when(t.rlike(lex.lyrics), "LYRICS").when(t.rlike(lex.screen), "SCREEN_TEXT")
    out = out.when(t.rlike(lex.message), "MESSAGE_LOG").when(t.rlike(lex.list_item), "LIST").when(t.rlike(lex.script), "SCRIPT")
    if lex.salutation:
        out = out.when(F.startswith(t, F.lit(lex.salutation)) & t.rlike(any_of(lex.colon)), "LETTER")
    return out.otherwise("PROSE")


def skips_reading(kind: Column) -> Column:
    return kind.isin("TOC_ENTRY", "UNKNOWN", "SEPARATOR", "BOILERPLATE")


def classified_lines(lines: DataFrame, anchors: DataFrame | None = None, id_col: str = "doc_id", lex: Lexicon = LATIN) -> DataFrame:
    """``lines`` with block_type and skip_read. ``anchors`` has id, line_no and kind (TOC_ENTRY, VOLUME_TITLE, CHAPTER_TITLE), which come before all tests, in that order."""
    kind = line_class(F.col("text"), lex)
    if anchors is not None:
        order = F.when(F.col("kind") == "TOC_ENTRY", 0).when(F.col("kind") == "VOLUME_TITLE", 1).otherwise(2)
        best = anchors.groupBy(id_col, "line_no").agg(F.min_by("kind", order).alias("__anchor"))
        lines = lines.join(best, [id_col, "line_no"], "left")
        kind = F.coalesce("__anchor", kind)
    out = lines.withColumn("block_type", kind).withColumn("skip_read", skips_reading(F.col("block_type")))
    return out.drop("__anchor")


def run_kind(text: Column, lex: Lexicon = LATIN) -> Column:
    """The class that a line may form a run of: a time stamp comes before a speaker's colon."""
    t = F.trim(text)
    return F.when(t.rlike(lex.message), "MESSAGE_LOG").when(t.rlike(lex.script), "SCRIPT").when(t.rlike(lex.list_item), "LIST")


def islands(rows: DataFrame, keys: list[str], order: str | list[str], kind: str) -> DataFrame:
    """``rows`` with ``island``: neighbours of one kind in ``order`` share a number; rows without a kind have none."""
    w = W.partitionBy(*keys).orderBy(order)
    rows = rows.withColumn("__rn", F.row_number().over(w))
    own = W.partitionBy(*keys, kind).orderBy(order)
    return rows.withColumn("island", F.when(F.col(kind).isNotNull(), F.col("__rn") - F.row_number().over(own))).drop("__rn")


def block_runs(lines: DataFrame, id_col: str = "doc_id", lex: Lexicon = LATIN) -> DataFrame:
    """Runs of script, message or list lines among the lines that aren't blank: id, kind, from_line, to_line, n_lines."""
    rows = lines.where(~F.col("is_blank")).withColumn("kind", run_kind(F.col("text"), lex))
    runs = islands(rows, [id_col], "line_no", "kind").where("kind is not null").groupBy(id_col, "kind", "island").agg(F.min("line_no").alias("from_line"), F.max("line_no").alias("to_line"), F.count("*").alias("n_lines"))
    least = F.try_element_at(F.create_map(*(F.lit(x) for kv in RUNS.items() for x in kv)), F.col("kind"))
    return runs.where(F.col("n_lines") >= least).drop("island")


def poetry_runs(lines: DataFrame, id_col: str = "doc_id", lex: Lexicon = LATIN, low: int = 4, high: int = 22, spread: int = 6, least: int = 3) -> DataFrame:
    """Runs of short lines without end marks or quotes whose lengths stay near the run's first: id, from_line, to_line, n_lines.

    A run is measured from its own first line, so where it ends decides where the next begins. Candidate stretches
    are cut out as islands first; only their (line, length) pairs go through the group map.
    """
    marks = any_of("".join(a + b for a, b in lex.quotes))
    fits = F.col("char_count").between(low, high) & ~one_of(last_char(F.col("text")), lex.terminal) & ~F.col("text").rlike(marks)
    rows = lines.where(~F.col("is_blank")).withColumn("fit", F.when(fits, "y"))
    rows = islands(rows, [id_col], "line_no", "fit").where("fit is not null").select(id_col, "island", "line_no", "char_count")
    rows = rows.withColumn("__n", F.count("*").over(W.partitionBy(id_col, "island"))).where(F.col("__n") >= least).drop("__n")

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("line_no")
        out, run = [], []
        for line, size in zip(part.line_no, part.char_count, strict=True):
            if run and abs(size - run[0][1]) > spread:
                out.append(run)
                run = []
            run.append((line, size))
        out.append(run)
        rows = [(part[id_col].iloc[0], r[0][0], r[-1][0], len(r)) for r in out if len(r) >= least]
        return pd.DataFrame(rows, columns=[id_col, "from_line", "to_line", "n_lines"])

    return rows.groupBy(id_col, "island").applyInPandas(walk, f"{id_col} {lines.schema[id_col].dataType.simpleString()}, from_line int, to_line int, n_lines int")
