"""As-of, interval and point-in-time joins over integer or time positions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.checkpoints import cut


def asof_last(points: DataFrame, facts: DataFrame, key: str | list[str], at: str, value: list[str], fact_at: str | None = None, tie: str | None = None, undated: bool = False) -> DataFrame:
    """``points`` with the fact columns of the latest fact at or before each point, of one key; null if there is none.

    Both sides go through one shuffle by key and a running last value: no range join, so a key with many facts costs
    its own rows once. Of facts at one position the largest ``tie`` counts. Facts without a position are left out or,
    if ``undated``, come before all others.
    """
    fact_at, keys = fact_at or at, [key] if isinstance(key, str) else key
    fact = (facts if undated else facts.where(F.col(fact_at).isNotNull())).select(*keys, F.col(fact_at).alias("__at"), (F.col(tie) if tie else F.lit(0)).cast("long").alias("__tie"), F.struct(*value).alias("__fact"))
    point = points.select(*keys, F.col(at).alias("__at"), F.lit(None).cast("long").alias("__tie"), F.struct(*points.columns).alias("__point"))
    both = fact.unionByName(point, allowMissingColumns=True)
    w = W.partitionBy(*keys).orderBy("__at", F.col("__point").isNotNull(), "__tie").rowsBetween(W.unboundedPreceding, 0)
    got = both.withColumn("__fact", F.last("__fact", ignorenulls=True).over(w)).where("__point is not null")
    return got.select("__point.*", *(F.col(f"__fact.{v}").alias(f"asof_{v}") for v in value))


def visible_attributes(points: DataFrame, facts: DataFrame, key: str, at: str, name: str, value: str, fact_at: str, tie: str) -> DataFrame:
    """For each point the latest value of every attribute known by then; attributes without a position are always known, and come first.

    One row for each point and attribute that has a value. Points meet the distinct attribute names of their key, as many
    rows as the result may have, and then one running last value by key and attribute: facts are never paired with points.
    """
    asked = points.join(facts.where(F.col(name).isNotNull()).select(key, F.col(name).alias(name)).distinct(), key)
    got = asof_last(asked, facts.select(key, name, F.col(fact_at).alias("__from"), F.col(tie).alias("__tie0"), F.struct(F.col(value).alias("v")).alias("__value")), [key, name], at, ["__value"], fact_at="__from", tie="__tie0", undated=True)
    return got.where("asof___value is not null").select(*points.columns, name, F.col("asof___value.v").alias(value))


RADIX = 4  # blocks of one level that make a block of the next


def _blocks(start: Column, end: Column, levels: int) -> Column:
    """array<struct<level, block>>: aligned blocks of RADIX ** level positions that cover [start, end] once, largest in the middle."""
    none = F.array().cast("array<struct<level:int,block:bigint>>")
    span = lambda level, a, b: F.when(a <= b, F.transform(F.sequence(a, b), lambda x: F.struct(level.cast("int").alias("level"), x.cast("long").alias("block")))).otherwise(none)
    up = lambda x: F.ceil(x / RADIX).cast("long")
    down = lambda x: F.floor((x + 1) / RADIX).cast("long")

    def step(s: Column, level: Column) -> Column:
        lo, hi = s["lo"], s["hi"]
        next_lo, next_hi = up(lo), down(hi) - 1
        inside = (level < levels) & (next_lo <= next_hi)
        left = span(level, lo, F.when(inside, next_lo * RADIX - 1).otherwise(hi))
        right = F.when(inside, span(level, (next_hi + 1) * RADIX, hi)).otherwise(none)
        return F.struct(F.when(inside, next_lo).otherwise(1).alias("lo"), F.when(inside, next_hi).otherwise(0).alias("hi"), F.concat(s["out"], left, right).alias("out"))

    zero = F.struct(start.cast("long").alias("lo"), end.cast("long").alias("hi"), none.alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(levels)), zero, step, lambda s: s["out"])


LEAF = 200_000  # rows of a key from which on it is swept in parts
PARTS = 256  # RADIX ** 4
ENDLESS = 2**63 - 1


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers points from a stack of the intervals begun and not ended; rows come by key and leaf, position, kind and tie.

    An interval that begins later and ends no sooner than another leaves nothing for it to win, so ends fall towards the
    top of the stack, and what ended before a point is popped for good.
    """
    last, stack = None, []
    for b in batches:
        kinds = b.column("kind").to_numpy()
        values, held = b.column("v").to_pylist(), []
        for k, leaf, x, kind, end, v in zip(b.column("k").to_pylist(), b.column("leaf").to_pylist(), b.column("x").to_pylist(), kinds.tolist(), b.column("e").to_pylist(), values, strict=True):
            if (k, leaf) != last:
                last, stack = (k, leaf), []
            if kind == 0:
                while stack and stack[-1][0] <= end:
                    stack.pop()
                stack.append((end, v))
            else:
                while stack and x is not None and stack[-1][0] < x:
                    stack.pop()
                held.append(stack[-1][1] if stack and x is not None else None)
        rows = b.column("row").filter(pa.array(kinds == 1))
        yield pa.RecordBatch.from_arrays([rows, pa.array(held, b.schema.field("v").type)], ["row", "held"])


def _covers(side: DataFrame) -> DataFrame:
    """k, leaf, s, e, t, v: of the intervals that cover a leaf wholly (a < leaf < z), the one that wins it."""
    levels = 4
    blocks = F.explode(_blocks(F.col("a") + 1, F.col("z") - 1, levels))
    best = F.max(F.struct("s", "t", "e", "v")).alias("w")
    winners = side.where("z - a > 1").select("k", "s", "t", "e", "v", blocks.alias("b")).groupBy("k", "b.level", "b.block").agg(best)
    width = F.pow(F.lit(float(RADIX)), F.col("level")).cast("long")
    leaves = winners.select("k", F.explode(F.sequence(F.col("block") * width, (F.col("block") + 1) * width - 1)).alias("leaf"), "w.*")
    return leaves.groupBy("k", "leaf").agg(best).select("k", "leaf", "w.*")


def stab(points: DataFrame, intervals: DataFrame, key: str, at: str, start: str, end: str, value: list[str], closed: bool = True, tie: str | None = None) -> DataFrame:
    """``points`` with the interval of their key that holds them; an open end is endless, and of several the latest start wins, then the largest ``tie``.

    Positions are integers; repeated points keep their rows, and points without a key or position hold nothing. ``closed``
    says whether the end belongs to the interval; one that ends before it starts, or has no start, holds nothing.

    Points and intervals of a key are sorted together once and swept in order, so no two sides are paired. A key of more
    than ``LEAF`` rows is cut at ``PARTS`` quantiles of its positions: an interval stands in the leaf where it starts and in
    the one where it ends, and of those that cover a leaf wholly one winner stands in it, found by aligned blocks of leaves.
    """
    stop = F.coalesce((F.col(end) if closed else F.col(end) - 1).cast("long"), F.lit(ENDLESS))
    side = intervals.where(F.col(key).isNotNull() & F.col(start).isNotNull() & (F.col(start) <= stop)).select(F.col(key).alias("k"), F.col(start).cast("long").alias("s"), stop.alias("e"), (F.col(tie) if tie else F.lit(0)).alias("t"), F.struct(*value).alias("v"))
    asked = points.select(F.col(key).alias("k"), F.col(at).cast("long").alias("x"), F.struct(*points.columns).alias("row"))
    places = side.select("k", F.col("s").alias("x")).unionByName(asked.select("k", "x")).where("k is not null")
    hot = cut(places.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > LEAF).select("k"))
    side, asked = side.withColumn("leaf", F.lit(0)), asked.withColumn("leaf", F.lit(0))
    if hot.limit(1).count():
        cuts = cut(places.join(hot, "k").groupBy("k").agg(F.array_distinct(F.percentile_approx("x", [i / PARTS for i in range(1, PARTS)], 10_000)).alias("cuts")))
        leaf = lambda x: F.coalesce(F.size(F.filter("cuts", lambda c: c <= F.col(x))), F.lit(0))
        placed = side.join(cuts, "k", "left").withColumn("a", leaf("s")).withColumn("z", leaf("e"))
        asked = asked.join(cuts, "k", "left").withColumn("leaf", F.when(F.col("x").isNull(), 0).otherwise(leaf("x"))).drop("cuts")
        whole = ["k", "leaf", "s", "e", "t", "v"]
        both = placed.withColumn("leaf", F.explode(F.array_distinct(F.array("a", "z")))).select(*whole)
        side = both.unionByName(_covers(placed).select(*whole))
    begun = side.select("k", "leaf", F.col("s").alias("x"), F.lit(0).alias("kind"), "t", "e", "v")
    rows = begun.unionByName(asked.select("k", "leaf", "x", F.lit(1).alias("kind"), "row"), allowMissingColumns=True)
    order = ["k", "leaf", "x", "kind", "t"]
    kinds = f"row {rows.schema['row'].dataType.simpleString()}, held {rows.schema['v'].dataType.simpleString()}"
    swept = rows.repartition("k", "leaf").sortWithinPartitions(*order).mapInArrow(_sweep, kinds)
    return swept.select("row.*", *(F.col(f"held.{v}").alias(f"held_{v}") for v in value))


def change_intervals(events: DataFrame, key: str, at: str, tie: str, value: str, clear: str = "CLEAR") -> DataFrame:
    """Intervals [start, end) between changes of a value; a clearing event ends one and starts none, the last one stays open."""
    w = W.partitionBy(key).orderBy(at, tie)
    rows = events.withColumn("__prev", F.lag(value).over(w)).where(F.col("__prev").isNull() | (F.col("__prev") != F.col(value)))
    rows = rows.withColumn("end_at", F.lead(at).over(w))
    return rows.where(F.col(value) != clear).select(key, value, F.col(at).alias("start_at"), "end_at")
