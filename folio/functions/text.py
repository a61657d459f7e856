"""Scalar text functions: separators, hashes, sentence cuts, spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HAN, ALNUM = r"\p{IsHan}", "[A-Za-z0-9]"


def starts_han(c: Column) -> Column:
    return c.rlike(f"^{HAN}")


def ends_han(c: Column) -> Column:
    return c.rlike(f"{HAN}$")


def join_separator(before: Column, after: Column) -> Column:
    """What goes between two joined lines: a space between ASCII letters or digits, and between them and Han; else nothing."""
    both = lambda a, b: before.rlike(f"{a}$") & after.rlike(f"^{b}")
    return F.when(both(ALNUM, ALNUM) | both(HAN, ALNUM) | both(ALNUM, HAN), " ").otherwise("")


def hash_of(*parts: Column, size: int = 32, sep: str = "|") -> Column:
    """The first ``size`` hex digits of the SHA-256 of the joined parts; nulls are empty."""
    text = F.concat_ws(sep, *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.substring(F.sha2(text.cast("binary"), 256), 1, size)


def name_set_revision(names: Column, version: int) -> Column:
    """Identity of a set of names: sorted, joined by U+0001, with the gate's version."""
    return hash_of(F.lit(str(version)), F.array_join(F.array_sort(F.array_distinct(names)), "\u0001"), size=16)


def java_float(c: Column) -> Column:
    """A float as Java prints it: 1 becomes 1.0."""
    return c.cast("float").cast("string")


def sentences(c: Column, ends: str = "。！？!?.") -> Column:
    """Sentences with their end marks, trimmed, without empty ones."""
    cls = "".join("\\" + x if x in "\\]^-[" else x for x in ends)
    return F.filter(F.transform(F.regexp_extract_all(c, F.lit(f"[^{cls}]+[{cls}]*"), F.lit(0)), lambda s: F.trim(s)), lambda s: s != "")


def truncated(c: Column, size: int = 48) -> Column:
    return F.when(F.length(c) > size, F.concat(F.left(c, F.lit(size)), F.lit("…"))).otherwise(c)


def occurrences(text: Column, needle: Column, overlapping: bool = True) -> Column:
    """How often ``needle`` stands in ``text``. Overlapping counts look at every start; an empty needle counts none."""
    apart = ((F.length(text) - F.length(F.replace(text, needle, F.lit("")))) / F.length(needle)).cast("int")
    starts = F.when(F.length(text) >= F.length(needle), F.sequence(F.lit(1), F.length(text) - F.length(needle) + 1)).otherwise(F.array().cast("array<int>"))
    every = F.size(F.filter(starts, lambda i: F.substring(text, i, F.length(needle)) == needle))
    return F.when(F.length(needle) > 0, every if overlapping else apart).otherwise(0)


def align(surface: Column, text: Column) -> Column:
    """Span of a surface in a text: status UNIQUE, AMBIGUOUS or ABSENT, count, start and end (from 0, of the first)."""
    n = occurrences(text, surface, overlapping=False)
    start = F.when(n > 0, F.position(surface, text) - 1)
    return F.struct(F.when(n == 1, "UNIQUE").when(n > 1, "AMBIGUOUS").otherwise("ABSENT").alias("status"), n.alias("n"), start.alias("start"), (start + F.length(surface)).alias("end"))


def contains_span(text: Column, span: Column) -> Column:
    """Exact containment of a span that isn't empty."""
    return (F.length(span) > 0) & F.contains(text, span)


def entity_uid(book: Column, kind: Column, key: Column) -> Column:
    return hash_of(book, kind, key, size=16)


def backoff_ms(base: Column, attempt: Column, limit: int = 62) -> Column:
    """base * 2^(attempt - 1)."""
    return base.cast("long") * F.pow(F.lit(2), F.least(F.greatest(attempt, F.lit(1)) - 1, F.lit(limit))).cast("long")


def segment_id(paragraph: Column, index: Column) -> Column:
    """paragraph * 1000 + index; distinct as long as a paragraph has at most 1000 segments."""
    return paragraph.cast("long") * 1000 + index


def extract_age(text: Column, name: Column, reach: int = 12) -> Column:
    """An age stated within ``reach`` characters after the name, else before it; 0 to 130."""
    at = F.position(name, text)
    ahead = F.substring(text, at + F.length(name), F.lit(reach))
    behind = F.substring(text, F.greatest(at - reach, F.lit(1)), F.least(at - 1, F.lit(reach)))
    number = r"(\d{1,3}|[〇零一二两三四五六七八九十百]{1,5})\s*(?:岁|years? old|ans\b|Jahre\b|años\b)"
    from folio.functions.numerals import parse_numeral

    value = lambda c: parse_numeral(F.nullif(F.regexp_extract(c, number, 1), F.lit("")))
    age = F.coalesce(value(ahead), value(behind))
    return F.when((at > 0) & age.between(0, 130), age)


def free_name(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores before it as no column of ``df`` is called, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while (name := f"_{name}") in taken:
        pass
    return name


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for each row, not at each use: what uses it often stays a small expression."""
    return F.transform(F.array(value), body)[0]
