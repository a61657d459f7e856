"""Layout profiles of line sets: one conditional aggregate, a histogram beside it, and a class by thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.lexicon import LATIN, Lexicon
from folio.operators.lines import last_char

BUCKET, NEAR, SHORT, LONG = 5, 2, 6, 1024
PROFILE = ["n", "median_len", "mean_len", "std_len", "mode_len", "near_mode", "blank_ratio", "full_indent", "space_indent", "tab_indent", "terminal", "colon_end", "colon_any", "quote_open", "separator", "very_short", "very_long", "distinct_len"]


def one_of(c: Column, chars: str) -> Column:
    return c.isin(*chars)


def any_of(chars: str) -> str:
    """A character class of literal characters."""
    return "[" + "".join("\\" + c if c in "\\]^-[" else c for c in chars) + "]"


def marks(lex: Lexicon) -> dict[str, Column]:
    """What a profile counts of the lines that aren't blank."""
    opening, closing = lex.quotes[0]
    last = last_char(F.col("text"))
    return {
        "full_indent": F.col("lead_full") >= 2, "space_indent": F.col("lead_space") >= 1, "tab_indent": F.col("lead_tab") >= 1, "terminal": one_of(last, lex.terminal), "colon_end": one_of(last, lex.colon),
        "colon_any": F.col("text").rlike(any_of(lex.colon)), "quote_open": F.regexp_count("text", F.lit(any_of(opening))) > F.regexp_count("text", F.lit(any_of(closing))), "separator": F.trim("text").rlike(lex.separator),
    }


def figures(base: DataFrame, keys: list[str], new_length: Column, *more: Column) -> DataFrame:
    """Profiles from counts, of lines or by length, with each key's ``mode_len``; ``new_length`` holds once for each length.

    A key whose lines are all blank has n = 0, and shares that are null.
    """
    w = W.partitionBy(*keys).orderBy("bucket", "char_count").rowsBetween(W.unboundedPreceding, 0)
    base = base.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(W.partitionBy(*keys)))
    at = lambda k: F.min(F.when((F.col("n") > 0) & (F.col("upto") > k), F.col("char_count")))
    median = (at(F.floor((F.col("total") - 1) / 2)) + at(F.floor(F.col("total") / 2))) / 2
    n = F.nullif(F.sum("n"), F.lit(0))
    share = lambda c: F.sum(c) / n
    mean = F.sum(F.col("n") * F.col("char_count")) / n
    square = F.sum(F.col("n") * F.col("char_count").cast("double") * F.col("char_count")) / n
    return base.groupBy(*keys).agg(
        F.sum("n").alias("n"), median.alias("median_len"), mean.alias("mean_len"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("std_len"), F.max("mode_len").alias("mode_len"),
        (F.sum(F.when(F.abs(F.col("char_count") - F.col("mode_len")) <= NEAR, F.col("n")).otherwise(0)) / n).alias("near_mode"), (F.sum(F.col("all") - F.col("n")) / F.sum("all")).alias("blank_ratio"),
        *(share(c).alias(c) for c in ("full_indent", "space_indent", "tab_indent", "terminal", "colon_end", "colon_any", "quote_open", "separator")),
        (F.sum(F.when(F.col("char_count") <= SHORT, F.col("n")).otherwise(0)) / n).alias("very_short"), (F.sum(F.when(F.col("char_count") > LONG, F.col("n")).otherwise(0)) / n).alias("very_long"), F.count_if(new_length).alias("distinct_len"), *more,
    )


def profile(lines: DataFrame, keys: list[str], lex: Lexicon = LATIN) -> DataFrame:
    """Counts, moments and ratios of the lines of each key. Two aggregates on the same keys share one shuffle of line rows."""
    live = ~F.col("is_blank")
    marked = lines.withColumn("bucket", F.floor(F.col("char_count") / BUCKET) * BUCKET)
    # one row for each (key, length): everything below is a sum of these, so only they are shuffled again
    by_length = marked.groupBy(*keys, "char_count", "bucket").agg(F.count_if(live).alias("n"), F.count("*").alias("all"), *(F.count_if(live & cond).alias(name) for name, cond in marks(lex).items()))
    hist = by_length.where("n > 0").groupBy(*keys, "bucket").agg(F.sum("n").alias("c"))
    mode = hist.groupBy(*keys).agg(F.min(F.struct((-F.col("c")).alias("c"), "bucket")).alias("m")).select(*keys, F.col("m.bucket").alias("mode_len"))
    return figures(by_length.join(mode, keys, "left"), keys, F.col("n") > 0).where("n > 0")


def profile_simple(lines: DataFrame, keys: list[str], lex: Lexicon = LATIN) -> DataFrame:
    """The same figures by Spark's exact ``median``; for groups whose lines fit one task, such as documents."""
    opening, closing = lex.quotes[0]
    live = lines.where(~F.col("is_blank"))
    last = last_char(F.col("text"))
    mode = live.groupBy(*keys, (F.floor(F.col("char_count") / BUCKET) * BUCKET).alias("bucket")).agg(F.count("*").alias("c")).groupBy(*keys).agg(F.min(F.struct((-F.col("c")).alias("c"), "bucket")).alias("m"))
    both = lines.join(mode.select(*keys, F.col("m.bucket").alias("mode")), keys)
    ok = ~F.col("is_blank")
    n = F.count_if(ok)
    share = lambda c: F.count_if(ok & c) / n
    length = F.when(ok, F.col("char_count"))
    return both.groupBy(*keys).agg(
        n.alias("n"), F.median(length).alias("median_len"), F.avg(length).alias("mean_len"), F.stddev_pop(length).alias("std_len"), F.max("mode").alias("mode_len"), share(F.abs(F.col("char_count") - F.col("mode")) <= NEAR).alias("near_mode"), (F.count_if(F.col("is_blank")) / F.count("*")).alias("blank_ratio"),
        share(F.col("lead_full") >= 2).alias("full_indent"), share(F.col("lead_space") >= 1).alias("space_indent"), share(F.col("lead_tab") >= 1).alias("tab_indent"), share(one_of(last, lex.terminal)).alias("terminal"), share(one_of(last, lex.colon)).alias("colon_end"),
        share(F.col("text").rlike(any_of(lex.colon))).alias("colon_any"), share(F.regexp_count("text", F.lit(any_of(opening))) > F.regexp_count("text", F.lit(any_of(closing)))).alias("quote_open"), share(F.trim("text").rlike(lex.separator)).alias("separator"),
        share(F.col("char_count") <= SHORT).alias("very_short"), share(F.col("char_count") > LONG).alias("very_long"), F.count_distinct(length).alias("distinct_len"),
    )


def histogram(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Lines that aren't blank by length bucket."""
    return lines.where(~F.col("is_blank")).groupBy(*keys, (F.floor(F.col("char_count") / BUCKET) * BUCKET).cast("int").alias("bucket")).agg(F.count("*").alias("n_lines"))


def top_modes(hist: DataFrame, keys: list[str], k: int = 3) -> DataFrame:
    """The k fullest buckets, the smaller one first among equals."""
    w = W.partitionBy(*keys).orderBy(F.col("n_lines").desc(), "bucket")
    return hist.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def profile_class() -> Column:
    """The class of a profile row; the first test that holds decides."""
    c = F.col
    return (
        F.when(c("separator") > 0.05, "MIXED")
        .when((c("very_short") > 0.5) & (c("terminal") < 0.3) & (c("median_len") < 24) & (c("std_len") < 8), "POETRY_LIKE")
        .when((c("colon_any") > 0.5) & (c("median_len") < 30), "SCRIPT_DIALOGUE")
        .when((c("near_mode") >= 0.45) & (c("mode_len") >= 8) & (c("terminal") < 0.55) & (c("full_indent") < 0.1) & (c("space_indent") < 0.1), "FIXED_WIDTH_HARD_WRAP")
        .when(c("blank_ratio") >= 0.15, "BLANK_LINE_PARAGRAPH")
        .when(c("full_indent").between(0.3, 0.95) & (c("terminal") > 0.5), "INDENTED_PARAGRAPH")
        .when((c("terminal") > 0.6) & (c("blank_ratio") < 0.12) & ((c("std_len") > 2) | (c("distinct_len") > 3)), "PARAGRAPH_PER_LINE")
        .when(c("very_long") > 0.1, "UNKNOWN")
        .otherwise("MIXED")
    )


def profile_confidence(kind: str = "profile_type") -> Column:
    c = F.col
    return (
        F.when(c(kind) == "FIXED_WIDTH_HARD_WRAP", F.greatest(F.lit(0.5), F.least(F.lit(1.0), c("near_mode") * 0.6 + (1 - c("terminal")) * 0.4)))
        .when(c(kind) == "BLANK_LINE_PARAGRAPH", c("blank_ratio") * 0.8 + 0.2)
        .when(c(kind) == "INDENTED_PARAGRAPH", c("full_indent") * 0.5 + c("terminal") * 0.3 + 0.2)
        .when(c(kind) == "PARAGRAPH_PER_LINE", c("terminal") * 0.6 + 0.3)
        .when(c(kind).isin("POETRY_LIKE", "SCRIPT_DIALOGUE"), 0.8)
        .otherwise(0.5)
    )


def classified(profiles: DataFrame) -> DataFrame:
    return profiles.withColumn("profile_type", profile_class()).withColumn("confidence", profile_confidence())


def cross_line_quotes(lines: DataFrame, keys: list[str], lex: Lexicon = LATIN) -> DataFrame:
    """Share of lines that begin inside a quotation; closing marks never take the depth below zero.

    A line maps depth d to max(d + net, floor), so the running depth is the net sum less its lowest point: two
    running window sums, no loop. ``lowest`` is the least prefix sum inside the line.
    """
    opening, closing = lex.quotes[0]
    marks = F.regexp_extract_all("text", F.lit(f"({any_of(opening)}|{any_of(closing)})"), F.lit(1))
    signs = F.transform(marks, lambda m: F.when(m == opening, 1).otherwise(-1))
    scan = F.aggregate(signs, F.struct(F.lit(0).alias("net"), F.lit(0).alias("low")), lambda a, x: F.struct((a["net"] + x).alias("net"), F.least(a["low"], a["net"] + x).alias("low")))
    rows = lines.where(~F.col("is_blank")).withColumn("scan", scan)
    before = W.partitionBy(*keys).orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("base", F.coalesce(F.sum("scan.net").over(before), F.lit(0)))
    floor = F.least(F.lit(0), F.coalesce(F.min(F.col("base") + F.col("scan.low")).over(before), F.lit(0)))
    return rows.withColumn("depth", F.col("base") - floor).groupBy(*keys).agg((F.count_if(F.col("depth") > 0) / F.count("*")).alias("quote_cross"))


def chapter_profiles(lines: DataFrame, starts: DataFrame, id_col: str = "doc_id", lex: Lexicon = LATIN) -> DataFrame:
    """Profiles of the lines from each chapter start to the next one. ``starts`` has id and start_line; lines before the first are left out."""
    marked = lines.join(starts.select(id_col, F.col("start_line").alias("line_no"), F.lit(True).alias("__start")), [id_col, "line_no"], "left")
    w = W.partitionBy(id_col).orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    marked = marked.withColumn("start_line", F.last(F.when(F.col("__start"), F.col("line_no")), ignorenulls=True).over(w)).where("start_line is not null")
    return classified(profile(marked.drop("__start"), [id_col, "start_line"], lex))


def layout_regions(lines: DataFrame, id_col: str = "doc_id", start: str = "start_line", window: int = 200, lex: Lexicon = LATIN) -> DataFrame:
    """Stretches of a chapter whose layout class differs from the whole chapter's.

    A region begins where the one before it ended and lasts until a window of ``window`` lines differs, whose class it
    gets; the last window ends one too. Lines are read once and shuffled once, by chapter and without their texts. Each
    counts for its window and for the chapter, which is window -1 and so the first row of the last window function.
    """
    chapter, keys, live = [id_col, start], [id_col, start, "win"], ~F.col("is_blank")
    rows = lines.select(*chapter, "line_no", F.when(live, F.col("char_count")).alias("char_count"), *(F.when(live, cond).alias(name) for name, cond in marks(lex).items()))
    rows = rows.withColumn("__first", F.min("line_no").over(W.partitionBy(*chapter)))
    rows = rows.withColumn("win", F.explode(F.array(F.lit(-1).cast("long"), F.floor((F.col("line_no") - F.col("__first")) / window))))
    rows = rows.withColumns({"bucket": F.floor(F.col("char_count") / BUCKET) * BUCKET, "n": F.col("char_count").isNotNull().cast("long"), "all": F.lit(1), **{name: F.col(name).cast("long") for name in marks(lex)}})
    # all windows up to the profiles want the lines in the same order, by bucket and length
    w = W.partitionBy(*keys, "bucket").orderBy("char_count")
    rows = rows.withColumns({"c": F.sum("n").over(w.rowsBetween(W.unboundedPreceding, 0)), "before": F.lag("char_count").over(w)})
    # the last line of a bucket has its whole count
    rows = rows.withColumn("mode_len", F.min(F.when(F.col("n") > 0, F.struct((-F.col("c")).alias("c"), "bucket"))).over(W.partitionBy(*keys))["bucket"])
    each = figures(rows, keys, ~F.col("char_count").eqNullSafe(F.col("before")), F.min("line_no").alias("lo"), F.max("line_no").alias("hi"))
    each = each.withColumn("profile_type", F.when(F.col("n") > 0, profile_class()))
    each = each.select(*keys, "lo", "hi", "profile_type", F.when(F.col("n") > 0, profile_confidence()).alias("confidence"))
    w = W.partitionBy(*chapter).orderBy("win")
    each = each.withColumns({"whole_type": F.first("profile_type").over(w), "after": F.lead("lo").over(w)})
    differs = ~F.col("profile_type").eqNullSafe(F.col("whole_type")) & (F.col("hi") > F.col("lo"))
    each = each.withColumn("ends", (F.col("win") < 0) | F.col("after").isNull() | differs)
    each = each.withColumn("from_line", F.last(F.when(F.col("ends"), F.col("after")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)))
    return each.where("ends and win >= 0").select(*chapter, F.col("from_line").cast("int").alias("from_line"), F.col("hi").cast("int").alias("to_line"), "profile_type", "confidence")
