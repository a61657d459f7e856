"""Splits, samples, mixtures and leak removal. Chance is a hash of the row's id and a seed, so every run draws the same."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.functions.text import free_name


def chance(seed: int, *ids: Column) -> Column:
    return F.xxhash64(F.lit(seed), *ids)


def md5_order(seed: int, c: Column) -> Column:
    """A pseudo-random order that SQL engines agree on."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), c.cast("string")).cast("binary"))


def ranked(rows: DataFrame, keys: list[str], order: Column, into: str) -> DataFrame:
    """``rows`` with ``into``: the place from 1 of each row of its key by ``order`` (a string or an integer).

    A key is dealt into ranges of the order by its leading characters or bits; ranges are counted, and rows are numbered
    within their range from its first place on. So neither a hot key nor the whole table is sorted in one task.
    """
    o, b, before = free_name(rows, "order"), free_name(rows, "range"), free_name(rows, "before")
    rows = rows.withColumn(o, order)
    text = rows.schema[o].dataType.typeName() == "string"
    rows = rows.withColumn(b, F.left(o, F.lit(3)) if text else F.shiftright(F.col(o).cast("long"), 52))
    w = W.partitionBy(*keys).orderBy(b).rowsBetween(W.unboundedPreceding, -1)
    counts = rows.groupBy(*keys, b).agg(F.count("*").alias("n")).withColumn(before, F.coalesce(F.sum("n").over(w), F.lit(0))).drop("n")
    renamed = [(k, free_name(rows, f"k_{k}")) for k in [*keys, b]]
    side = counts.select(*(F.col(k).alias(n) for k, n in renamed), before)
    same = F.lit(True)
    for k, n in renamed:
        same = same & F.col(k).eqNullSafe(F.col(n))
    met = rows.join(side, same)
    place = F.row_number().over(W.partitionBy(*keys, b).orderBy(o)) + F.col(before)
    return met.withColumn(into, place).drop(o, b, before, *(n for _, n in renamed))


def stratified_split(rows: DataFrame, stratum: str, order: Column, parts: list[tuple[str, float]]) -> DataFrame:
    """``rows`` with split: each stratum is cut at the cumulative shares, by ``order``. A stratum may hold most rows."""
    at, n, key = free_name(rows, "at"), free_name(rows, "n"), free_name(rows, "stratum")
    sizes = rows.groupBy(F.col(stratum).alias(key)).agg(F.count("*").alias(n))
    placed = ranked(rows, [stratum], order, at).join(sizes, F.col(stratum).eqNullSafe(F.col(key)))
    share = (F.col(at) - 1) / F.col(n)
    upto, split = 0.0, None
    for name, part in parts[:-1]:
        upto += part
        split = F.when(share < upto, name) if split is None else split.when(share < upto, name)
    return placed.withColumn("split", split.otherwise(parts[-1][0]) if split is not None else F.lit(parts[-1][0])).drop(at, n, key)


def group_split(rows: DataFrame, group: str, order: Column, train: float, dev: float, overrides: DataFrame | None = None) -> DataFrame:
    """Splits whole groups: ranked by ``order``, with at least one dev and one test group from three groups on; overrides come first."""
    groups = rows.select(group).distinct()
    if overrides is not None:
        groups = groups.join(overrides.select(group, F.col("split").alias("__fixed")), group, "left")
    else:
        groups = groups.withColumn("__fixed", F.lit(None).cast("string"))
    free = groups.where("__fixed is null")
    n = free.count()
    n_dev = max(1, round(n * dev)) if n >= 3 else 0
    n_test = max(1, n - round(n * train) - n_dev) if n >= 3 else 0
    placed = ranked(free.withColumn("__all", F.lit(0)), ["__all"], order, "__rn")
    split = F.when(F.col("__rn") <= n - n_dev - n_test, "train").when(F.col("__rn") <= n - n_test, "dev").otherwise("test")
    named = placed.select(group, split.alias("split")).unionByName(groups.where("__fixed is not null").select(group, F.col("__fixed").alias("split")))
    return rows.join(named, group)


def quota_per(rows: DataFrame, keys: list[str], order: list, n: int | Column) -> DataFrame:
    """The first ``n`` rows of each key."""
    return rows.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("__rn") <= n).drop("__rn")


def hard_pool(rows: DataFrame, score: str, keep_from: int, low_quota: int, order: Column) -> DataFrame:
    """All rows of a high score, and a fixed quota of each lower one."""
    return rows.where(F.col(score) >= keep_from).unionByName(quota_per(rows.where(F.col(score) < keep_from), [score], [order], low_quota))


def round_robin(rows: DataFrame, group: str, order: Column, n: int) -> DataFrame:
    """``n`` rows taken from the groups in turn: first rows of all groups, then second ones."""
    turn = rows.withColumn("turn", F.row_number().over(W.partitionBy(group).orderBy(order)))
    # no group gives more than n rows, so its others needn't be sorted
    return turn.where(F.col("turn") <= n).orderBy("turn", group).limit(n)


def filled_quota(rows: DataFrame, keys: list[str], kind: Column, quotas: dict[str, int], order: list) -> DataFrame:
    """Rows of two kinds by quota for each key, with ``kind``; what one kind hasn't got, the other may fill.

    Kinds are counted with partial sums, and no key keeps more rows of a kind than both quotas together while rows are
    ranked. Rows of any other kind, or of none, are left out.
    """
    (one, n), (two, m) = quotas.items()
    told = rows.withColumn("kind", kind).where(F.col("kind").isin(one, two))
    counts = told.groupBy(*keys).agg(*(F.count_if(F.col("kind") == k).alias(f"__n{i}") for i, k in enumerate((one, two))))
    ranked = told.withColumn("__rn", F.row_number().over(W.partitionBy(*keys, "kind").orderBy(*order))).where(F.col("__rn") <= n + m)
    spare = lambda have, quota: F.greatest(F.lit(quota) - F.col(have), F.lit(0))
    most = F.when(F.col("kind") == one, n + spare("__n1", m)).otherwise(m + spare("__n0", n))
    return ranked.join(counts, keys).where(F.col("__rn") <= most).drop("__rn", "__n0", "__n1")


def layered_round_robin(rows: DataFrame, layers: list[tuple[str, Column, int]], group: str, key: str, order: Column) -> DataFrame:
    """Round-robin samples of several layers, none of which takes a row that an earlier one has."""
    taken, out = None, []
    for name, condition, n in layers:
        pool = rows.where(condition)
        if taken is not None:
            pool = pool.join(taken, key, "left_anti")
        got = round_robin(pool, group, order, n).withColumn("layer", F.lit(name))
        out.append(got)
        taken = got.select(key) if taken is None else taken.union(got.select(key))
    return reduce(DataFrame.unionByName, out)


def leak_free(train: DataFrame, held: DataFrame, text_col: str = "text", names: list[str] | None = None) -> DataFrame:
    """Training rows whose text, with names normalised to X, equals no held-out text: an anti-join on digests."""
    key = lambda c: F.sha2(normalized(c, names).cast("binary"), 256)
    return train.withColumn("__k", key(F.col(text_col))).join(held.select(key(F.col(text_col)).alias("__k")).distinct(), "__k", "left_anti").drop("__k")


def normalized(c: Column, names: list[str] | None = None) -> Column:
    text = F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    return F.regexp_replace(text, "|".join("\\Q" + n.lower() + "\\E" for n in sorted(names, key=len, reverse=True)), "X") if names else text


def exact_duplicates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Digest classes with more than one document: digest, n, first id. Only ids and digests are shuffled."""
    return docs.select(id_col, F.sha2(F.col(text_col).cast("binary"), 256).alias("digest")).groupBy("digest").agg(F.count("*").alias("n"), F.min(id_col).alias("first_id")).where("n > 1")


def import_outcome(docs: DataFrame, id_col: str, name_col: str, text_col: str) -> DataFrame:
    """DUPLICATE of an earlier document by content, else NEW_REVISION of an earlier one of the same name, else NEW."""
    rows = docs.select(id_col, name_col, F.sha2(F.col(text_col).cast("binary"), 256).alias("digest"))
    same = F.min(id_col).over(W.partitionBy("digest"))
    rows = rows.withColumn("duplicate_of", F.when(same < F.col(id_col), same))
    first = F.min(F.when(F.col("duplicate_of").isNull(), F.col(id_col))).over(W.partitionBy(name_col))
    return rows.withColumn("outcome", F.when(F.col("duplicate_of").isNotNull(), "DUPLICATE").when(first < F.col(id_col), "NEW_REVISION").otherwise("NEW"))


def keep_first(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    return quota_per(rows, keys, order, 1)


def mixture(pools: list[tuple[DataFrame, int]], seed: int, key: str) -> DataFrame:
    """Union of pools, each row as often as its pool's factor, in a seeded order."""
    parts = [df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(n)))) for df, n in pools]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).orderBy(chance(seed, F.col(key), F.col("copy")))


def rotations(candidates: Column) -> Column:
    """All rotations of an array, from its own order on."""
    n = F.size(candidates)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.concat(F.slice(candidates, k + 1, n), F.slice(candidates, 1, k)))).otherwise(F.array(candidates))


def lcg_permutation(items: Column, seed: Column) -> Column:
    """Fisher-Yates by a 64-bit linear congruential generator that wraps: the same order for the same seed.

    Multiplication is done in two halves of the state, so that it wraps as unsigned arithmetic does.
    """
    # fixed values: multiplier and increment of the generator
    high, low, add = 6364136223846793005 >> 32, 6364136223846793005 & 0xFFFFFFFF, 1442695040888963407
    mask = F.lit(0xFFFFFFFF).cast("long")
    word = lambda x: x.cast("decimal(38,0)")
    modulus = F.lit(str(2**64)).cast("decimal(38,0)")

    def following(s: Column) -> Column:
        hi, lo = F.shiftrightunsigned(s, 32), s.bitwiseAND(mask)
        cross = F.pmod(word(hi) * low + word(lo) * high, F.lit(2**32).cast("decimal(38,0)"))
        total = F.pmod(F.pmod(word(lo) * low, modulus) + cross * F.lit(2**32).cast("decimal(38,0)") + F.lit(add), modulus)
        return F.when(total >= F.lit(str(2**63)).cast("decimal(38,0)"), total - modulus).otherwise(total).cast("long")

    zero = F.struct(items.alias("a"), seed.cast("long").alias("s"))

    def step(acc: Column, i: Column) -> Column:
        s = following(acc["s"])
        j = F.pmod(F.shiftrightunsigned(s, 33), i + 1).cast("int")
        swapped = F.transform(acc["a"], lambda x, k: F.when(k == i, F.get(acc["a"], j)).when(k == j, F.get(acc["a"], i)).otherwise(x))
        return F.struct(swapped.alias("a"), s.alias("s"))

    order = F.when(F.size(items) > 1, F.sequence(F.size(items) - 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(order, zero, step, lambda acc: acc["a"])


def bucket_of(text: Column, buckets: list[tuple[str, str]], rest: str = "NONE") -> Column:
    """The first bucket whose pattern is found."""
    return F.coalesce(*(F.when(text.rlike(p), F.lit(name)) for name, p in buckets), F.lit(rest))


def equal_quota(rows: DataFrame, bucket: str, total: int, n_buckets: int, order: Column) -> DataFrame:
    return quota_per(rows, [bucket], [order], total // max(1, n_buckets))


def from_first_chapter(lines: DataFrame, keys: list[str], is_chapter: Column, want: int) -> DataFrame:
    """Lines from the first chapter line on, numbered by chapter, until ``want`` chapters have passed."""
    w = W.partitionBy(*keys).orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    return lines.withColumn("chapter_no", F.sum(is_chapter.cast("int")).over(w)).where(F.col("chapter_no").between(1, want))


def priority_top(rows: DataFrame, score: Column, n: int, tie: str) -> DataFrame:
    return rows.withColumn("score", score).orderBy(F.col("score").desc(), tie).limit(n)


def hardness(signals: list[Column]) -> Column:
    return sum((F.coalesce(s, F.lit(False)).cast("int") for s in signals), F.lit(0))


def united(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct keys of two sets, with in_first and in_second; where only one holds, the row is of the difference, where both do, of the intersection."""
    both = first.select(*keys, F.lit(1).alias("__a"), F.lit(0).alias("__b")).unionByName(second.select(*keys, F.lit(0).alias("__a"), F.lit(1).alias("__b")))
    return both.groupBy(*keys).agg((F.max("__a") == 1).alias("in_first"), (F.max("__b") == 1).alias("in_second"))
