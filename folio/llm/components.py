"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from folio.llm.common import cut

EDGES_IN_TASK = 100_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (a, b) with b < a. Each node's neighbours (the larger ones, or the smaller ones and itself) move to its least neighbour.

    Both rows of an edge come from one scan of it, not from a union of two, which would have twice the tasks.
    """
    if large:
        near = edges.select(_rows(("a", "b"), ("b", "a"), names=("u", "v")))
    else:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    met = near.join(least, "u")
    moved = met.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")) if large else met.select(_rows(("v", "m"), ("u", "m"), names=("a", "b")))
    return moved.where("a <> b").distinct()


def _rows(*pairs: tuple[str, str], names: tuple[str, str]) -> Column:
    """A row for each pair of columns."""
    return F.inline(F.array(*(F.struct(F.col(x).alias(names[0]), F.col(y).alias(names[1])) for x, y in pairs)))


def _digest(edges: DataFrame) -> Row:
    """Count and sum of hashes; equal for equal sets of edges."""
    return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()


def _in_few(edges: DataFrame, n: int) -> DataFrame:
    """``n`` edges in as many partitions as they need, so that rounds over few edges are few tasks."""
    return edges.coalesce(n // EDGES_IN_TASK + 1)


def _links(edges: DataFrame) -> DataFrame:
    """Edges with the larger node first, without nulls, loops and repeats."""
    return edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def contract(edges: DataFrame, rounds: int = 2) -> DataFrame:
    """Edges (a, b) of the same components after some rounds, nearly stars already; long paths may need more rounds."""
    now = cut(_links(edges))
    n = now.count()
    for _ in range(rounds):
        now = _in_few(cut(_star(_star(_in_few(now, n), True), False)), n)
    return now


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (the least node reachable) for every node of ``edges`` (a, b: long).

    Nulls and loops are left out. Each round is a few shuffles of the edges, and their number grows with the logarithm
    of the longest path, squared at most; nothing but a count and a digest of the edges comes to the driver.
    """
    now = cut(_links(edges))
    mark = _digest(now)
    while True:
        now = cut(_star(_star(_in_few(now, mark[0]), True), False))
        last, mark = mark, _digest(now)
        if mark == last:
            break
    now = _in_few(now, mark[0])
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())


def labels(stars: DataFrame) -> DataFrame:
    """node, component by the edges of ``contract``: each node's least neighbour, which is in its component."""
    return stars.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
