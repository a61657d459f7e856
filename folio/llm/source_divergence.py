"""Source divergence audit: how far each source's words are from the other sources' and from its language's.

Texts become terms inside tasks, where counts of (lang, source, term) and of documents are summed before they are
shuffled. One shuffle by (lang, term) then gives every term its posting list: the sources that use it, with counts.
Only terms in ``MIN_DOCS`` documents of their lang are kept.

Smoothed probabilities are integers, p = 1 + floor(SCALE * (count + SMOOTH) / (N + SMOOTH * V)), so all sums are exact.

Pairs: let z be the p of an unseen term of a source. Over all kept terms, the sum of |p_a - p_b| is what a's own terms
are from b's z, plus what b's own terms are from a's z, plus |z_a - z_b| for the rest, plus a correction for each term
that both use. The first two need only how many terms of a source have which count (buckets of equal counts); the
corrections come from posting lists alone, ``SOURCES`` by ``SOURCES`` sources at a time, added up in a matrix inside the
task. So neither unseen terms nor pairs of rows are ever written.

Terms: the terms of a source are put into buckets by count. A bucket's largest p less the smallest p that its terms have
in the whole lang bounds every difference in it. Buckets are evaluated best bound first, a few at a time, until each source
has ``top`` terms and no unseen bound reaches the last of them; a bound that equals it is still evaluated, for its ties.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import cut

MIN_DOCS, TOP, SCALE, SMOOTH = 30, 50, 1_000_000_000, 5
SOURCES, ENTRIES, CELLS = 256, 400_000, 2_000_000
#: Maps A-Z to a-z and every other ASCII byte but a-z to a space; bytes from 0x80 are parts of terms.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
COUNTS = "lang string, source string, term binary, n long, docs long"


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and documents of each (lang, source, term), summed over as many texts as ``ENTRIES`` sums allow; a null term stands for the group."""
    words: dict[tuple, Counter] = defaultdict(Counter)
    docs: dict[tuple, Counter] = defaultdict(Counter)

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), seen in words.items():
            terms, had = list(seen), docs[lang, source]
            fixed = [pa.array([v] * (len(terms) + 1), pa.string()) for v in (lang, source)]
            yield pa.RecordBatch.from_arrays([*fixed, pa.array([None, *terms], pa.binary()), pa.array([0, *seen.values()], pa.int64()), pa.array([0, *(had[t] for t in terms)], pa.int64())], ["lang", "source", "term", "n", "docs"])
        words.clear()
        docs.clear()

    size = 0
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            for lang, source, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                found, key = text.translate(LETTERS).split(), (lang, source)
                before = len(words[key])
                words[key].update(found)
                docs[key].update(set(found))
                size += len(words[key]) - before + (not before)
                if size >= ENTRIES:
                    yield from flush()
                    size = 0
    yield from flush()


def probability(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (n + SMOOTH) / (total + SMOOTH * kept)), exact for any counts."""
    up = (n + SMOOTH).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    low = (total + kept * SMOOTH).cast("decimal(20,0)")
    return F.call_function("div", up, low).cast("long") + 1


class Audit:
    """The tables that both parts read: groups, kept terms with posting lists, and the p of each."""

    def __init__(self, docs: DataFrame, min_docs: int):
        empty = F.lit("")
        given = docs.select(F.coalesce(F.col("lang").cast("string"), empty).alias("lang"), F.coalesce(F.col("source").cast("string"), empty).alias("source"), F.coalesce(F.col("text").cast("binary"), empty.cast("binary")).alias("text"))
        counted = given.mapInArrow(count_terms, COUNTS).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        posting = F.collect_list(F.struct("source", "n"))
        lists = counted.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"), posting.alias("posting"))
        lists = cut(lists.where(F.col("term").isNull() | (F.col("docs") >= min_docs)).drop("docs"))
        self.groups = lists.where("term is null").select("lang", F.explode("posting.source").alias("source"))
        self.lists = lists.where("term is not null")
        langs = self.lists.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("lang_n"))
        uses = self.lists.select("lang", F.explode("posting").alias("u")).groupBy("lang", F.col("u.source").alias("source")).agg(F.sum("u.n").alias("own_n"), F.count("*").alias("used"))
        own = self.groups.join(langs, "lang", "left").join(uses, ["lang", "source"], "left").na.fill(0, ["kept", "lang_n", "own_n", "used"])
        zero = F.when(F.col("kept") > 0, probability(F.lit(0), F.col("own_n"), F.col("kept"))).otherwise(0)
        number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
        #: lang, source, kept (V), lang_n, own_n (N), used (terms with a count), z, number
        self.sources = cut(own.withColumn("z", zero).withColumn("number", number))
        rows = self.lists.select("lang", "term", "total", F.inline("posting")).join(self.sources, ["lang", "source"])
        #: lang, source, term, n, p, q (p of the lang), z, number
        self.rows = cut(rows.select("lang", "source", "term", "n", probability(F.col("n"), F.col("own_n"), F.col("kept")).alias("p"), probability(F.col("total"), F.col("lang_n"), F.col("kept")).alias("q"), "z", "number"))


def shared_terms(rows: DataFrame) -> DataFrame:
    """lang, a, b, more: for sources a < b by number, the corrections of all terms that both use."""
    block = (F.col("number") / SOURCES).cast("int")
    parts = rows.groupBy("lang", "term", block.alias("block")).agg(F.collect_list(F.struct("number", "p", "z")).alias("u"))
    terms = parts.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("block", "u"))).alias("blocks"))
    pairs = F.flatten(F.transform("blocks", lambda x: F.transform(F.filter("blocks", lambda y: y["block"] >= x["block"]), lambda y: F.struct(x["block"].alias("i"), y["block"].alias("j"), x["u"].alias("x"), y["u"].alias("y")))))
    met = terms.select("lang", F.inline(pairs)).select("lang", "i", "j", *(F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "xy" for c in ("number", "p", "z")))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, i, j), m in sums.items():
                a, b = np.nonzero(m)
                keep = a + i * SOURCES < b + j * SOURCES
                a, b = a[keep], b[keep]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(a + i * SOURCES, pa.int64()), pa.array(b + j * SOURCES, pa.int64()), pa.array(m[a, b], pa.int64())], ["lang", "a", "b", "more"])
            sums.clear()

        for b in batches:
            keys = np.array(list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)), dtype=object)
            for key in set(map(tuple, keys)):
                part = b.filter(pa.array([tuple(k) == key for k in keys]))
                side = [[np.zeros((part.num_rows, SOURCES), np.int64) for _ in range(3)] for _ in range(2)]
                for s, at in ((0, 3), (1, 6)):
                    lists = part.column(at)
                    row = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
                    col = np.asarray(lists.flatten()) - key[1 + s] * SOURCES
                    for m, values in zip(side[s], (np.ones(len(row), np.int64), np.asarray(part.column(at + 1).flatten()), np.asarray(part.column(at + 2).flatten())), strict=True):
                        m[row, col] = values
                wide = [1 + max(np.flatnonzero(side[s][0].any(axis=0)), default=0) for s in range(2)]
                total = sums.setdefault(key, np.zeros((SOURCES, SOURCES), np.int64))
                step = max(1, CELLS // (wide[0] * wide[1]))
                for t in range(0, part.num_rows, step):
                    (hx, px, zx), (hy, py, zy) = ([m[t : t + step, : wide[s]] for m in side[s]] for s in range(2))
                    x = lambda m: m[:, :, None]
                    y = lambda m: m[:, None, :]
                    more = np.abs(x(px) - y(py)) - np.abs(x(px) - y(zy)) - np.abs(x(zx) - y(py)) + np.abs(x(zx) - y(zy))
                    total[: wide[0], : wide[1]] += (more * (x(hx) * y(hy))).sum(axis=0)
                if len(sums) > 64:
                    yield from flush()
        yield from flush()

    return met.mapInArrow(add, "lang string, a long, b long, more long").groupBy("lang", "a", "b").agg(F.sum("more").alias("more"))


def source_pairs(audit: Audit) -> DataFrame:
    """lang, source, item, value, rank: the summed difference of each source from each other one of its lang."""
    ends = audit.sources.select("lang", "source", "number", "kept", "used", "z")
    other = ends.select("lang", *(F.col(c).alias(f"other_{c}") for c in ("source", "number", "used", "z")))
    levels = audit.rows.groupBy("lang", "source", "p").agg(F.count("*").alias("terms"))
    # what a source's own terms are from another source's z
    far = levels.join(other.select("lang", "other_number", "other_z"), "lang").groupBy("lang", "source", "other_number").agg(F.sum(F.col("terms") * F.abs(F.col("p") - F.col("other_z"))).alias("far"))
    far = cut(far.join(ends.select("lang", "source", "number"), ["lang", "source"]).select("lang", "number", "other_number", "far"))
    back = far.select("lang", F.col("number").alias("other_number"), F.col("other_number").alias("number"), F.col("far").alias("back"))
    shared = shared_terms(audit.rows)
    both = shared.union(shared.select("lang", "b", "a", "more")).toDF("lang", "number", "other_number", "more")
    key = ["lang", "number", "other_number"]
    met = ends.join(other, "lang").where("number <> other_number").join(far, key, "left").join(back, key, "left").join(both, key, "left").na.fill(0, ["far", "back", "more"])
    rest = (F.col("kept") - F.col("used") - F.col("other_used")) * F.abs(F.col("z") - F.col("other_z"))
    value = F.col("far") + F.col("back") + rest + F.col("more")
    out = met.select("lang", "source", F.col("other_source").alias("item"), value.cast("long").alias("value"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def top_terms(audit: Audit, top: int) -> DataFrame:
    """lang, source, item, value, rank: each source's ``top`` terms that it uses most beyond its lang."""
    group = ["lang", "source"]
    rows = audit.rows.select("lang", "source", F.col("term").alias("item"), "p", "q", F.floor(F.log2("n") * 2).cast("int").alias("bucket"))
    bounds = rows.groupBy(*group, "bucket").agg((F.max("p") - F.min("q")).alias("bound"), F.count("*").alias("terms")).where("bound > 0")
    w = Window.partitionBy(*group).orderBy(F.desc("bound"), "bucket")
    bounds = cut(bounds.withColumn("before", F.coalesce(F.sum("terms").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    place = Window.partitionBy(*group).orderBy(F.desc("value"), "item")
    best, reach, todo, parts = None, top, bounds, []
    while True:
        now = todo.where(F.col("before") < reach).select(*group, "bucket")
        seen = rows.join(now, [*group, "bucket"], "left_semi").select(*group, "item", (F.col("p") - F.col("q")).alias("value")).where("value > 0")
        best = (seen if best is None else best.select(*group, "item", "value").unionByName(seen)).withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)
        best = cut(best)
        left = todo.where(F.col("before") >= reach)
        last = best.groupBy(*group).agg(F.count("*").alias("found"), F.min("value").alias("kth"))
        open_ = left.groupBy(*group).agg(F.max("bound").alias("next")).join(last, group, "left").where((F.coalesce("found", F.lit(0)) < top) | (F.col("next") >= F.col("kth"))).select(*group)
        open_ = cut(open_)
        parts.append(best.join(open_, group, "left_anti"))
        if not open_.limit(1).count():
            break
        best, todo, reach = best.join(open_, group, "left_semi"), left.join(open_, group, "left_semi"), reach * 4
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank for every (lang, source) of ``docs`` (text, lang, source).

    Part ``pair`` has a row for each other source of the lang, part ``term`` one for each of the ``top`` terms that stand
    furthest above the lang. Nulls are empty strings, and an empty lang or source is one like any other. A source alone in
    its lang has no pairs; without kept terms all pairs are 0. Bytes that are no UTF-8 stay in the terms. Repeated rows count
    each time. Other columns are ignored; without rows the result is empty. Ties are ordered by the item's UTF-8 bytes.
    """
    audit = Audit(docs, min_docs)
    pairs = source_pairs(audit).withColumn("part", F.lit("pair"))
    terms = top_terms(audit, top).withColumn("item", F.col("item").cast("string")).withColumn("part", F.lit("term"))
    columns = ["lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank")]
    return pairs.select(*columns).unionByName(terms.select(*columns))
