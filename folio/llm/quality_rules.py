"""Quality rules: a threshold table compiled into one projection over the text, without user functions.

``RULES`` names a ratio, a comparison and a threshold in each row. ``measures`` states the ratios as SQL
expressions over the text alone, so the whole verdict is a narrow projection: no shuffle, no join, no Python, and
its cost is linear in the text but for the sort of a document's own three-word windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import WORD_BREAK, ascii_lower, let

#: Frequent short words of the corpus languages.
STOP_WORDS = ["a", "the", "of", "and", "to", "in", "is", "that", "for", "with", "der", "die", "das", "und", "in", "den", "von", "zu", "mit", "le", "la", "les", "de", "et", "des", "un", "une", "que", "el", "los", "en", "y", "por", "las", "del"]
#: Fixed values: (rule, ratio, a document is rejected if the ratio is so, threshold).
RULES = [
    ("too_short", "n_words", "<", 50),
    ("repeated_windows", "repeat_share", ">", 0.5),
    ("short_words", "mean_word_chars", "<", 2.0),
    ("long_words", "mean_word_chars", ">", 15.0),
    ("symbols", "symbol_share", ">", 0.3),
    ("few_stop_words", "stop_share", "<", 0.02),
    ("upper_case", "upper_share", ">", 0.6),
    ("repeated_lines", "dup_line_share", ">", 0.5),
    ("bullet_lines", "bullet_line_share", ">", 0.9),
    ("cut_lines", "ellipsis_line_share", ">", 0.3),
]
BASE_RULES = ("too_short", "repeated_windows")


def same(a: Column, b: Column) -> Column:
    """Equality that is false for nulls."""
    return F.coalesce(a == b, F.lit(False))


def repeated_window_words(words: Column, size: int = 3) -> Column:
    """Words that lie in a window of ``size`` words found twice or more, the first one included.

    Windows are sorted by (hash, place); those equal to a neighbour repeat. Each repeated window then adds the words
    up to the next one's start. Windows are compared by 64-bit hashes.
    """
    n = F.size(words)
    places = F.when(n >= size, F.sequence(F.lit(0), n - size)).otherwise(F.array().cast("array<int>"))
    windows = F.sort_array(F.transform(places, lambda i: F.struct(F.xxhash64(*(F.get(words, i + k) for k in range(size))).alias("h"), i.alias("i"))))
    twice = lambda p: F.filter(p, lambda x, k: same(F.get(p, k - 1)["h"], x["h"]) | same(F.get(p, k + 1)["h"], x["h"]))
    starts = let(windows, lambda p: F.sort_array(F.transform(twice(p), lambda x: x["i"])))
    step = lambda r: F.transform(r, lambda i, k: F.least(F.lit(size), F.coalesce(F.get(r, k + 1) - i, F.lit(size))))
    return let(starts, lambda r: F.aggregate(step(r), F.lit(0).cast("long"), lambda a, x: a + x))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def word_counts(words: Column) -> Column:
    """A struct of what the words of a text say."""
    stop = F.array(*(F.lit(w) for w in dict.fromkeys(STOP_WORDS)))
    return F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.size(F.filter(words, lambda w: F.array_contains(stop, ascii_lower(w)))).cast("long").alias("n_stop_words"),
        repeated_window_words(words).alias("n_repeat_words"),
    )


def line_counts(lines: Column) -> Column:
    """A struct of what the lines that have a word say."""
    return F.struct(
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(lines, lambda x: x.rlike(r"^\s*[-*\u2022\u00b7]"))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|\u2026)\s*$"))).cast("long").alias("n_cut_lines"),
    )


def counts(text: Column) -> Column:
    """All counts of a text as one struct; a null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, WORD_BREAK), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    chars = F.struct(
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace(text, r"[^\p{L}]+", "")).cast("long").alias("n_letters"),
    )
    return F.struct(let(words, word_counts).alias("w"), let(lines, line_counts).alias("l"), chars.alias("c"))


def share(part: Column, whole: Column) -> Column:
    """part / whole, or 0 of nothing."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def ratios(c: Column) -> dict[str, Column]:
    """The ratios that rules may name, from the struct of ``counts``."""
    w, lines, chars = c["w"], c["l"], c["c"]
    return {
        "n_words": w["n_words"],
        "repeat_share": share(w["n_repeat_words"], w["n_words"]),
        "mean_word_chars": share(w["word_chars"], w["n_words"]),
        "symbol_share": share(chars["n_symbols"], w["n_words"]),
        "stop_share": share(w["n_stop_words"], w["n_words"]),
        "upper_share": share(chars["n_upper"], chars["n_letters"]),
        "dup_line_share": share(lines["n_dup_lines"], lines["n_lines"]),
        "bullet_line_share": share(lines["n_bullet_lines"], lines["n_lines"]),
        "ellipsis_line_share": share(lines["n_cut_lines"], lines["n_lines"]),
    }


def failed(rules: list[tuple], c: Column) -> Column:
    """The names of the rules that reject a document, in the table's order."""
    by_name = ratios(c)
    checks = [F.when(by_name[ratio] < limit if kind == "<" else by_name[ratio] > limit, F.lit(name)) for name, ratio, kind, limit in rules]
    return F.array_compact(F.array(*checks))


def apply_rules(docs: DataFrame, rules: list[tuple] = RULES, text_col: str = "text", into: str = "quality_rules") -> DataFrame:
    """``docs`` with one more struct column ``into``: the counts, ``failed`` (rule names) and ``kept`` (none failed).

    A null text counts as empty, and so is too short. Every row and every other column is kept; a column that
    already has the name ``into`` is replaced.
    """
    given = docs.withColumn(into, counts(F.col(text_col)))
    return given.withColumn(into, let(failed(rules, F.col(into)), lambda f: F.struct(F.col(into).alias("counts"), f.alias("failed"), (F.size(f) == 0).alias("kept"))))
