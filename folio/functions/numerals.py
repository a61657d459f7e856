"""Numerals in Chinese, full-width and Arabic digits, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Numeral characters and what they stand for.
DIGITS = {"〇": 0, "零": 0, "一": 1, "壹": 1, "二": 2, "贰": 2, "两": 2, "三": 3, "叁": 3, "四": 4, "肆": 4, "五": 5, "伍": 5, "六": 6, "陆": 6, "七": 7, "柒": 7, "八": 8, "捌": 8, "九": 9, "玖": 9}
UNITS = {"十": 10, "拾": 10, "百": 100, "佰": 100, "千": 1000, "仟": 1000}
BIG = "万"
NUMERAL = "".join(DIGITS) + "".join(UNITS) + BIG


def normalize_digits(c: Column) -> Column:
    """Full-width digits as ASCII, without white space."""
    return F.regexp_replace(F.translate(c, "０１２３４５６７８９", "0123456789"), r"[\s\x{3000}]+", "")


def parse_numeral(c: Column) -> Column:
    """The number that a numeral states, or null.

    Plain digits and runs of digit characters are read by place; with units, each digit counts by the unit after it, and
    what stands before the ten-thousands mark counts that many times. A unit without a digit before it counts nothing,
    but for a ten that begins the numeral, which counts once.
    """
    text = normalize_digits(c)
    plain = F.translate(text, "".join(DIGITS), "".join(map(str, DIGITS.values())))
    unit = F.create_map(*(F.lit(x) for kv in UNITS.items() for x in kv))
    chars = F.split(plain, "")
    zero = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("section"), F.lit(-1).cast("long").alias("digit"))

    def step(a: Column, x: Column) -> Column:
        held = F.when(a["digit"] >= 0, a["digit"]).otherwise(0)
        first_ten = (F.try_element_at(unit, x) == 10) & (a["section"] == 0) & (a["total"] == 0)
        base = F.when(a["digit"] > 0, a["digit"]).when(first_ten, 1).otherwise(0)
        big = F.struct(((a["section"] + held) * 10000 + a["total"]).alias("total"), F.lit(0).cast("long").alias("section"), F.lit(-1).cast("long").alias("digit"))
        by_unit = F.struct(a["total"].alias("total"), (a["section"] + base * F.try_element_at(unit, x)).cast("long").alias("section"), F.lit(-1).cast("long").alias("digit"))
        by_digit = F.struct(a["total"].alias("total"), a["section"].alias("section"), F.coalesce(x.try_cast("long"), F.lit(0).cast("long")).alias("digit"))
        return F.when(x == BIG, big).when(F.try_element_at(unit, x).isNotNull(), by_unit).otherwise(by_digit)

    mixed = F.aggregate(chars, zero, step, lambda a: a["total"] + a["section"] + F.when(a["digit"] >= 0, a["digit"]).otherwise(0))
    known = plain.rlike(f"^[0-9{''.join(UNITS)}{BIG}]+$")
    return F.when(plain.rlike("^[0-9]+$"), plain.try_cast("int")).when(known, mixed.try_cast("int"))
