"""Line dedup by winnowing over line hashes.

A document is its sequence of lines that have a word, as 64-bit hashes. A gram starts at each line and takes as
many lines as hold ``GRAM_WORDS`` words. Of the grams inside each window of ``RUN_WORDS`` words the one with the
smallest hash is a fingerprint, so any run of whole lines with that many words holds one, wherever it stands.
Fingerprints meet their earliest position in the corpus; from there a match is extended line by line both ways,
``RUN_WORDS`` lines at most, which reaches the next fingerprint of the run. Extended runs are deleted; the
earliest position stays.

A match that is shorter than ``RUN_WORDS`` words deletes nothing. The earliest holder of a fingerprint may have only a
piece of a passage that later documents share, so the windows that chose the fingerprint but aren't in what it matched meet
the earliest holder of the same fingerprint in the same window: a second equi-join, of those windows alone. An earlier
window like it has the same fingerprint, the same earliest holder and the same short match, so it is in that join, too.
What goes is therefore exactly each run of whole lines of ``RUN_WORDS`` words or more that stands at an earlier position.

Only fingerprints, windows of short matches, and the hash arrays of documents that share fingerprints, are shuffled; each
fingerprint joins one earliest position, never all others, so a passage in a third of all documents costs one row for each
of them.
All steps are DataFrame expressions. Documents are ordered by id and, of one id, by a hash of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import WORD, cut, free_name, let, quoted

GRAM_WORDS, RUN_WORDS = 25, 50
HAS_WORD = r"[^\x20\x09-\x0D]"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def words_from(counts: Column, at: Column, least: int) -> Column:
    """How many lines from ``at`` hold ``least`` words, or null if the text ends before. Each line has a word."""
    zero = F.struct(F.lit(0).alias("words"), F.lit(0).alias("lines"))
    step = lambda a, x: F.when(a["words"] >= least, a).otherwise(F.struct((a["words"] + x).alias("words"), (a["lines"] + 1).alias("lines")))
    got = F.aggregate(F.slice(counts, at + 1, least), zero, step)
    return let(got, lambda g: F.when(g["words"] >= least, g["lines"]))


def picks(h: Column, counts: Column, gram_words: int, run_words: int) -> Column:
    """array<struct<fp, k>>: for each line, the fingerprint of the window that starts there and the line at which it stands; null without a window."""
    n = F.size(h)
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def gram(i: Column) -> Column:
        return let(words_from(counts, i, gram_words), lambda m: F.struct(F.when(m.isNotNull(), F.xxhash64(F.slice(h, i + 1, m))).alias("fp"), (i + m).alias("end"), i.alias("k")))

    def pick(grams: Column) -> Column:
        def of(i: Column) -> Column:
            inside = lambda m: F.filter(F.slice(grams, i + 1, m), lambda g: F.coalesce(g["end"] <= i + m, F.lit(False)))
            return let(words_from(counts, i, run_words), lambda m: F.when(m.isNotNull(), F.array_min(F.transform(inside(m), lambda g: F.struct(g["fp"].alias("fp"), g["k"].alias("k"))))))

        return F.transform(places, of)

    return let(F.transform(places, gram), pick)


def window_sizes(counts: Column, run_words: int) -> Column:
    """struct<ahead, back>: for each line, of how many lines the shortest run of ``run_words`` words from it, and up to it, is; 0 if there is none."""
    ahead = lambda c: F.transform(c, lambda _, i: F.coalesce(words_from(c, i, run_words), F.lit(0)))
    return F.struct(ahead(counts).alias("ahead"), F.reverse(let(F.reverse(counts), ahead)).alias("back"))


def sequences(docs: DataFrame, id_col: str, text_col: str, gram_words: int, run_words: int) -> DataFrame:
    """doc, tx (hash of the text), h and p (hashes and places of lines that have a word), ahead and back (``window_sizes``), at (the places in ``picks``), fps."""
    text = F.col(text_col)
    every = F.transform(lines_of(text), lambda x, i: F.struct(F.xxhash64(x).alias("h"), i.alias("p"), F.regexp_count(x, F.lit(WORD)).alias("w")))
    lines = let(every, lambda a: F.filter(a, lambda x: x["w"] > 0))
    given = docs.where(F.col(id_col).isNotNull() & text.isNotNull()).select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("tx"), lines.alias("l"))
    given = given.select("doc", "tx", F.col("l.h").alias("h"), F.col("l.p").alias("p"), F.col("l.w").alias("w"))
    given = given.select("doc", "tx", "h", "p", window_sizes(F.col("w"), run_words).alias("m"), picks(F.col("h"), F.col("w"), gram_words, run_words).alias("picks"))
    return given.select("doc", "tx", "h", "p", "m.ahead", "m.back", F.col("picks.k").alias("at"), F.array_distinct(F.array_compact("picks")).alias("fps"))


def again(met: DataFrame) -> DataFrame:
    """doc, tx, start, end: places of the windows (doc, tx, fp, lines, k, start, end) that stand at an earlier position, too."""
    key = met.select("doc", "tx", "k", "start", "end", "fp", F.xxhash64("lines").alias("hash"), F.hash("lines").alias("check"))
    first = key.groupBy("fp", "hash", "check").agg(F.min(F.struct("doc", "tx", "k")).alias("src"), F.count("*").alias("n")).where("n > 1").drop("n")
    return key.join(first, ["fp", "hash", "check"]).where(F.struct("doc", "tx", "k") > F.col("src")).select("doc", "tx", "start", "end")


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram_words: int = GRAM_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """doc, tx, runs: for each document with deleted runs, their [start, end] line places from 0, merged and sorted."""
    seq = cut(sequences(docs, id_col, text_col, gram_words, run_words))
    seen = seq.select("doc", "tx", F.explode("fps").alias("f")).select("doc", "tx", F.col("f.k").alias("k"), F.col("f.fp").alias("fp"))
    first = seen.groupBy("fp").agg(F.min(F.struct("doc", "tx", "k")).alias("src"), F.count("*").alias("n")).where("n > 1").drop("n")
    met = seen.join(first, "fp").where(F.struct("doc", "tx", "k") > F.col("src"))
    shift = F.col("k") - F.col("src.k")
    met = met.groupBy("doc", "tx", F.col("src.doc").alias("src_doc"), F.col("src.tx").alias("src_tx"), shift.alias("shift")).agg(F.collect_set(F.struct("k", "fp")).alias("ks"))
    own = seq.drop("fps").distinct()
    lo = F.greatest(F.array_min("ks.k") - run_words, F.col("shift"), F.lit(0))
    hi = F.array_max("ks.k") + 2 * run_words
    part = F.slice("src_h", lo - F.col("shift") + 1, hi - lo + 1)
    source = own.select(F.col("doc").alias("src_doc"), F.col("tx").alias("src_tx"), F.col("h").alias("src_h"))
    met = met.join(source, ["src_doc", "src_tx"]).select("doc", "tx", "ks", lo.alias("lo"), part.alias("part"))
    both = met.join(own, ["doc", "tx"])
    # breaks: places around the fingerprints at which the two documents differ or one of them ends
    differs = F.filter(F.transform("part", lambda x, i: F.when(F.coalesce(x == F.get(F.col("h"), i + F.col("lo")), F.lit(False)), F.lit(None)).otherwise(i + F.col("lo"))), lambda b: b.isNotNull())
    bounds = F.concat(F.array(F.col("lo") - 1, F.col("lo") + F.size("part")), differs)
    # from the break before to the break after; where the fingerprint's own line differs (a hash met by chance) this is nothing
    after = lambda k, b: F.array_min(F.filter(b, lambda x: x >= k)) - 1
    reach = lambda x, b: F.struct(x["k"].alias("k"), x["fp"].alias("fp"), F.greatest(F.array_max(F.filter(b, lambda y: y < x["k"])) + 1, x["k"] - run_words).alias("a"), F.least(after(x["k"], b), x["k"] + 2 * run_words).alias("z"))
    runs = let(bounds, lambda b: F.transform("ks", lambda x: reach(x, b)))
    both = cut(both.select("doc", "tx", "h", "p", "ahead", "back", "at", runs.alias("runs")))
    long = F.filter("runs", lambda r: (F.get("ahead", r["a"]) > 0) & (r["a"] + F.get("ahead", r["a"]) - 1 <= r["z"]))
    placed = F.transform(long, lambda r: F.struct(F.get("p", r["a"]).alias("start"), F.get("p", r["z"]).alias("end")))
    # windows that chose a fingerprint and aren't in what it matched: those from a line on, and those up to a line
    window = lambda r, a, n: F.when((n > 0) & (F.get("at", a) == r["k"]) & ~((r["a"] <= a) & (a + n - 1 <= r["z"])), F.struct(r["fp"].alias("fp"), a.alias("k"), n.alias("n")))
    from_ = lambda r: F.transform(F.sequence(F.greatest(r["k"] - run_words, F.lit(0)), r["k"]), lambda i: window(r, i, F.get("ahead", i)))
    up_to = lambda r: F.transform(F.sequence(r["k"], F.least(r["k"] + run_words, F.size("h") - 1)), lambda i: window(r, i - F.get("back", i) + 1, F.get("back", i)))
    short = F.array_distinct(F.array_compact(F.flatten(F.transform("runs", lambda r: F.concat(from_(r), up_to(r))))))
    open_ = both.select("doc", "tx", "h", "p", F.inline(short)).select("doc", "tx", "fp", "k", F.slice("h", F.col("k") + 1, F.col("n")).alias("lines"), F.get("p", F.col("k")).alias("start"), F.get("p", F.col("k") + F.col("n") - 1).alias("end"))
    return merged_runs(both.select("doc", "tx", F.inline(placed)).union(again(open_)))


def merged_runs(runs: DataFrame) -> DataFrame:
    """doc, tx, runs: the [start, end] of each document sorted, those that touch or overlap joined."""
    w = Window.partitionBy("doc", "tx").orderBy("start", "end")
    reached = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.coalesce(F.col("start") <= F.col("reached") + 1, F.lit(False)), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    joined = runs.distinct().withColumn("reached", reached).withColumn("island", island).groupBy("doc", "tx", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return joined.groupBy("doc", "tx").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("runs"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram_words: int = GRAM_WORDS, run_words: int = RUN_WORDS, into: str = "removed_runs") -> DataFrame:
    """``docs`` with later repeated runs of lines deleted from the texts, and the runs in a new column ``into``.

    A run is deleted from its first line to its last one, lines without words between them included; all other
    lines stay as they are, in order. A document that loses every line keeps its row with an empty text. Null texts
    and rows with a null id stay as they are, with no runs. Rows that repeat an id and a text count as one document:
    none is deleted in favour of the other. Every other column is kept, and a column named as ``into`` is replaced;
    ``n_chars``, if there, is counted anew where lines went.
    """
    doc, tx, found, key = (free_name(docs, x) for x in ("doc", "tx", "runs", "key"))
    runs = repeated_runs(docs, id_col, text_col, gram_words, run_words).select(F.col("doc").alias(doc), F.col("tx").alias(tx), F.col("runs").alias(found))
    keyed = docs.drop(into) if into in docs.columns else docs
    names = keyed.columns
    both = keyed.withColumn(key, F.xxhash64(text_col)).join(runs, (F.col(id_col) == F.col(doc)) & (F.col(key) == F.col(tx)), "left")
    # the lines before the first run, between runs and after the last one
    begin = lambda i: F.when(i > 0, F.get(found, i - 1)["end"] + 1).otherwise(0)
    between = lambda a: F.flatten(F.transform(F.sequence(F.lit(0), F.size(found)), lambda i: F.slice(a, begin(i) + 1, F.coalesce(F.get(found, i)["start"], F.size(a)) - begin(i))))
    stays = let(lines_of(F.col(text_col)), between)
    text = F.when(F.col(found).isNull(), F.col(text_col)).otherwise(F.array_join(stays, "\n"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    out = both.select(*(text.alias(c) if c == text_col else q for c, q in zip(names, quoted(names), strict=True)), F.coalesce(found, none).alias(into))
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.size(into) > 0, F.length(text_col)).otherwise(F.col("n_chars")).cast(kind))
    return out
