"""Integrity checks: orphans, duplicates, gaps, counts before and after."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """Child rows whose key isn't null and has no parent: an anti-join, so null keys don't hide others."""
    return child.where(F.col(fk).isNotNull()).join(parent.select(F.col(pk).alias(fk)).distinct(), fk, "left_anti")


def duplicate_groups(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def span_gaps(rows: DataFrame, keys: list[str], index: str, base: int = 0) -> DataFrame:
    """Groups whose index doesn't run from ``base`` without a gap: count differs from max + 1 - base."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.max(index).alias("top")).where(F.col("n") != F.col("top") + 1 - base)


def issues(checks: dict[str, DataFrame]) -> DataFrame:
    """One row for each check with its number of bad rows."""
    return reduce(DataFrame.unionByName, (df.agg(F.count("*").alias("n_bad")).select(F.lit(name).alias("check"), "n_bad") for name, df in checks.items()))


def table_counts(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, (df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows") for name, df in sorted(tables.items())))


def preserved(before: DataFrame, after: DataFrame) -> DataFrame:
    """Tables that lost rows or went missing in a migration."""
    both = before.join(after.withColumnRenamed("n_rows", "n_after"), "table_name", "left")
    return both.where(F.coalesce("n_after", F.lit(-1)) < F.col("n_rows"))


def monotone_breaks(rows: DataFrame, keys: list[str], seq: str, order: list[str]) -> DataFrame:
    """Rows whose ``order`` tuple is less than that of the row before, by ``seq``."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*keys).orderBy(seq)
    return rows.withColumn("__now", F.struct(*order)).withColumn("__before", F.lag("__now").over(w)).where("__now < __before").drop("__now", "__before")


def record_diff(left: DataFrame, right: DataFrame, on: list[str], fields: list[str]) -> DataFrame:
    """Full outer comparison by key: status SAME, DIFFERENT (with the fields), LEFT_ONLY or RIGHT_ONLY."""
    a = left.select(*on, F.struct(*fields).alias("a"))
    b = right.select(*on, F.struct(*fields).alias("b"))
    both = a.join(b, on, "full")
    changed = F.array_compact(F.array(*(F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f)) for f in fields)))
    status = F.when(F.col("b").isNull(), "LEFT_ONLY").when(F.col("a").isNull(), "RIGHT_ONLY").when(F.size(changed) > 0, "DIFFERENT").otherwise("SAME")
    return both.select(*on, status.alias("status"), F.when(status == "DIFFERENT", changed).otherwise(F.array().cast("array<string>")).alias("fields"))


def golden(df: DataFrame) -> DataFrame:
    """Row count and an order-free digest, to compare a replay with its recording."""
    return df.agg(F.count("*").alias("n_rows"), F.sum(F.xxhash64(*df.columns).cast("decimal(20,0)")).cast("string").alias("digest"))


def present(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """``expected`` with status FOUND or MISSING."""
    side = found.select(key, F.lit(True).alias("__there")).distinct()
    return expected.join(side, key, "left").withColumn("status", F.when(F.col("__there"), "FOUND").otherwise("MISSING")).drop("__there")
