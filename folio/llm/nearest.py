"""Approximate nearest neighbours by multi-index hashing: the candidates of largest inner product for each query.

Inner products become angles by one more component: rows are divided by the largest norm of all rows and completed to
length one, queries are scaled to length one and get 0 there. Principal axes and an iterated rotation that brings them
close to the corners of a cube (fit on ``SAMPLE`` rows, those with the smallest hash of their id) give ``BITS`` signs.

A code is cut into ``PARTS`` substrings, and each is an index of its own. By the pigeonhole principle a code within
Hamming radius r of a query's has a substring within r // PARTS of the query's (one less from the substring
r % PARTS + 1 on), so probing those buckets finds every code within r. A pair that several substrings would find is
taken by the first of them alone. What is found is ranked by the original vectors in the task that found it, and only
the best k for each query and block are shuffled on.

The radius is fit, too: ``PROBES`` rows get their exact neighbours among all rows in one linear pass, and the radius is
the one that holds a share ``TARGET`` of these. A query that has fewer than k candidates within it is searched again with
a wider one, up to all bits, where nothing is left out.

Buckets are shuffled by substring and the leading bits of its value, as many as bring a bucket range to ``BLOCK`` rows.
Ranges with more rows (a hot code) or more queries are cut by hashes of ids into blocks that meet pair by pair, so no
task holds more than about ``BLOCK`` rows and ``QUERY_BLOCK`` queries. Of rows with equal vectors only the k + 1 smallest
ids can be among anyone's k nearest, so the others are left out before the index is made: results stay whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import cut

BITS, PARTS = 64, 4
WIDTH = BITS // PARTS
SAMPLE, PROBES, TARGET = 8192, 256, 0.97
BLOCK, QUERY_BLOCK, PAIRS = 32_768, 8192, 2_000_000
LOW = np.uint64((1 << WIDTH) - 1)


class Coder(NamedTuple):
    """Learned codes: the largest norm, the mean of the completed rows, and the axes whose signs are the bits."""

    largest: float
    mean: np.ndarray
    axes: np.ndarray

    def codes(self, x: np.ndarray, query: bool) -> np.ndarray:
        """A 64-bit code for each row of ``x``."""
        norms = np.linalg.norm(x, axis=1)
        scaled = x / (norms[:, None] if query else self.largest)
        rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(0.0, 1.0 - (norms / self.largest) ** 2))
        signs = (np.column_stack([scaled, rest]) - self.mean) @ self.axes > 0
        return np.packbits(signs, axis=1, bitorder="little").view("<u8")[:, 0]


def fit(x: np.ndarray, largest: float, rounds: int = 30) -> Coder:
    """A coder from sample rows ``x``; fewer components than bits are rotated several times."""
    norms = np.linalg.norm(x, axis=1)
    full = np.column_stack([x / largest, np.sqrt(np.maximum(0.0, 1.0 - (norms / largest) ** 2))])
    mean = full.mean(axis=0)
    axes = np.linalg.eigh((full - mean).T @ (full - mean))[1][:, ::-1][:, :BITS]
    flat, made, rng = (full - mean) @ axes, [], np.random.default_rng(7)
    while sum(m.shape[1] for m in made) < BITS:
        turn = np.linalg.qr(rng.normal(size=(axes.shape[1], axes.shape[1])))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.where(flat @ turn > 0, 1.0, -1.0).T @ flat)
            turn = (u @ v).T
        made.append(axes @ turn)
    return Coder(largest, mean, np.hstack(made)[:, :BITS])


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column as rows of doubles."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(lists.flatten(), dtype=np.float64).reshape(len(lists), -1)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from the first component to the last, so equal vectors have equal scores everywhere."""
    return np.cumsum(a * b, axis=1)[:, -1]


def best(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """The places of the k best of each query, by falling score, then rising id."""
    order = np.lexsort((ids, -scores, query))
    first = np.r_[True, query[order][1:] != query[order][:-1]]
    run = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    return order[run < k]


def ranked(rows: np.ndarray, q: np.ndarray, x: np.ndarray, ids: np.ndarray, allowed: np.ndarray, k: int):
    """(query row, place in x, score) of the k best allowed pairs of each query; sums in any order choose, exact ones rank."""
    scores = np.where(allowed, q @ x.T, -np.inf)
    if scores.shape[1] > k:
        kth = np.partition(scores, -k, axis=1)[:, -k]
        slack = 1e-12 * np.linalg.norm(q, axis=1) * (np.linalg.norm(x, axis=1).max())
        allowed = allowed & (scores >= (kth - slack)[:, None])
    a, b = np.nonzero(allowed)
    got = exact(q[a], x[b])
    keep = best(a, ids[b], got, k)
    return rows[a[keep]], b[keep], got[keep]


def radii(radius: int) -> list[int]:
    """The radius within which each substring is probed; -1 for none."""
    return [radius // PARTS - (j > radius % PARTS) for j in range(PARTS)]


def substring(codes: np.ndarray, j: int) -> np.ndarray:
    return (codes >> np.uint64(WIDTH * j)) & LOW


def valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v: rows that take part, one for each id."""
    v = F.col(vector_col)
    whole = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    given = vectors.where(F.col(id_col).isNotNull() & F.coalesce(whole, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    return given.groupBy("vec_id").agg(F.min("v").alias("v"))


def calibrate(coded: DataFrame, coder: Coder, ids: np.ndarray, x: np.ndarray, k: int) -> int:
    """The Hamming radius that holds ``TARGET`` of the k nearest of the rows ``x``, by one pass over all rows."""
    codes = coder.codes(x, True)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]
        for b in batches:
            if b.num_rows:
                other, at = np.asarray(b.column("vec_id")), np.asarray(b.column("code")).view(np.uint64)
                rows, place, score = ranked(np.arange(len(x)), x, matrix(b.column("v")), other, ids[:, None] != other[None, :], k)
                far = np.bitwise_count(codes[rows] ^ at[place]).astype(np.int64)
                held = [np.concatenate(p) for p in zip(held, (rows, other[place], score, far), strict=True)]
                keep = best(held[0], held[1], held[2], k)
                held = [h[keep] for h in held]
        yield pa.RecordBatch.from_arrays([pa.array(h) for h in held], ["probe", "vec_id", "score", "far"])

    found = coded.mapInArrow(near, "probe long, vec_id long, score double, far long")
    place = F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("score"), "vec_id"))
    far = sorted(r.far for r in found.withColumn("r", place).where(F.col("r") <= k).select("far").collect())
    return int(far[math.ceil(TARGET * len(far)) - 1]) if far else BITS


def search(index: DataFrame, queries: DataFrame, n: int, radius: int, k: int) -> DataFrame:
    """query_id, vec_id, score: for each query the k best of all rows whose codes are within ``radius``."""
    within, lead = radii(radius), min(WIDTH, max(0, math.ceil(math.log2(max(n, 1) / BLOCK))))
    shift = WIDTH - lead
    ranges = np.arange(1 << lead, dtype=np.uint64)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = np.asarray(b.column("code")).view(np.uint64)
            for j in range(PARTS):
                own = substring(codes, j) >> np.uint64(shift)
                for at in range(0, len(codes), 1024):
                    row, to = np.nonzero(np.bitwise_count(own[at : at + 1024, None] ^ ranges[None, :]) <= within[j])
                    for some in range(0, len(row), 8192):
                        part = b.take(pa.array(at + row[some : some + 8192]))
                        ends = [pa.array(np.full(part.num_rows, j, np.int32)), pa.array(to[some : some + 8192].astype(np.int32))]
                        yield pa.RecordBatch.from_arrays([*ends, part.column("query_id"), part.column("code"), part.column("v")], ["j", "range", "query_id", "code", "v"])

    kind = index.schema["v"].dataType.simpleString()
    probes = queries.mapInArrow(probe, f"j int, range int, query_id long, code long, v {kind}")
    cuts = F.array(*(F.struct(F.lit(j).alias("j"), F.shiftrightunsigned("code", WIDTH * j + shift).bitwiseAND((1 << lead) - 1).cast("int").alias("range")) for j in range(PARTS) if within[j] >= 0))
    cells = index.select("vec_id", "code", "v", F.inline(cuts))
    # at most PARTS * 2 ** WIDTH rows
    sizes = cells.groupBy("j", "range").count().join(probes.groupBy("j", "range").agg(F.count("*").alias("asked")), ["j", "range"])
    sizes = F.broadcast(cut(sizes.select("j", "range", F.ceil(F.col("count") / BLOCK).alias("s"), F.ceil(F.col("asked") / QUERY_BLOCK).alias("t"))))
    other = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    left = probes.join(sizes, ["j", "range"]).withColumn("t", F.pmod(F.xxhash64("query_id"), "t")).withColumn("s", other("s"))
    right = cells.join(sizes, ["j", "range"]).withColumn("s", F.pmod(F.xxhash64("vec_id"), "s")).withColumn("t", other("t"))

    def meet(asked: pa.Table, held: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if asked.num_rows and held.num_rows:
            j = asked.column("j")[0].as_py()
            codes, x, ids = np.asarray(held.column("code")).view(np.uint64), matrix(held.column("v")), np.asarray(held.column("vec_id"))
            order = np.argsort(substring(codes, j), kind="stable")
            codes, x, ids = codes[order], x[order], ids[order]
            values, bucket = np.unique(substring(codes, j), return_inverse=True)
            q, qcodes, qids = matrix(asked.column("v")), np.asarray(asked.column("code")).view(np.uint64), np.asarray(asked.column("query_id"))
            qsub, made = substring(qcodes, j), []
            for s in np.unique(qsub):
                rows = np.flatnonzero((np.bitwise_count(values ^ s) <= within[j])[bucket])
                same = np.flatnonzero(qsub == s)
                step = max(1, PAIRS // max(1, len(rows)))
                for at in range(0, len(same) if len(rows) else 0, step):
                    some = same[at : at + step]
                    apart = qcodes[some][:, None] ^ codes[rows][None, :]
                    ok = (np.bitwise_count(apart) <= radius) & (ids[rows][None, :] != qids[some][:, None])
                    for i in range(j):
                        ok &= np.bitwise_count(substring(apart, i)).astype(np.int16) > within[i]
                    use = np.flatnonzero(ok.any(axis=0))
                    if len(use):
                        a, b, score = ranked(some, q[some], x[rows[use]], ids[rows[use]], ok[:, use], k)
                        made.append((qids[a], ids[rows[use][b]], score))
            if made:
                out = [np.concatenate(p) for p in zip(*made, strict=True)]
        return pa.table([pa.array(c) for c in out], ["query_id", "vec_id", "score"])

    key = ["j", "range", "s", "t"]
    met = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(meet, "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", place).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, queries=lambda i: i % 20 == 0, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each row that ``queries`` picks by its id.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows with a null id.
    Of rows that repeat an id, the one with the smallest vector counts. If lengths differ, the most frequent one (then the
    longest) counts. Ties go to the smaller id. A query never finds its own id. Other columns are ignored. Without rows
    the result is empty.
    """
    given = cut(valid(vectors, id_col, vector_col))
    lengths = given.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    result = "query_id long, rank int, vec_id long, score double"
    if lengths is None:
        return vectors.sparkSession.createDataFrame([], result)
    given = given.where(F.size("v") == lengths.d)
    most = math.sqrt(given.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))).first()[0])
    sample = given.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    ids, x = np.asarray(sample.column("vec_id")), matrix(sample.column("v"))
    coder = fit(x, most)

    def encode(query: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(coder.codes(matrix(b.column(1)), query).view(np.int64))], [*b.schema.names, "code"])

        return run

    kind = given.schema["v"].dataType.simpleString()
    copy = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    first = given.withColumn("copy", copy).where(F.col("copy") <= k + 1).select("vec_id", "v")
    index = cut(first.mapInArrow(encode(False), f"vec_id long, v {kind}, code long"))
    asked = cut(given.where(queries(F.col("vec_id"))).select(F.col("vec_id").alias("query_id"), "v").mapInArrow(encode(True), f"query_id long, v {kind}, code long"))
    n = index.count()
    radius = calibrate(index, coder, ids[:PROBES], x[:PROBES], k) if n > k + 1 else BITS
    parts = []
    while True:
        found = cut(search(index, asked, n, radius, k))
        if radius >= BITS:
            parts.append(found)
            break
        short = asked.join(found.groupBy("query_id").count().where(F.col("count") >= k), "query_id", "left_anti")
        parts.append(found.join(short.select("query_id"), "query_id", "left_anti"))
        asked = cut(short)
        if not asked.limit(1).count():
            break
        radius = min(BITS, radius + PARTS * 2)
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
