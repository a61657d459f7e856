"""Evaluation of predictions: confusion, F1, error rates, ranks, percentiles, audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(part, F.lit(0)) / F.greatest(F.coalesce(whole, F.lit(0)), F.lit(1))


def confusion(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Counts of (gold, pred) over labelled rows."""
    return rows.where("gold is not null").groupBy(*(keys or []), "gold", "pred").agg(F.count("*").alias("n"))


def class_scores(conf: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """tp, fp, fn and F1 of every class that occurs as gold or prediction; a class without a hit scores 0."""
    keys = keys or []
    sides = F.explode(F.array(F.struct(F.col("gold").alias("label"), F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("fp"), F.when(F.coalesce(F.col("gold") != F.col("pred"), F.lit(True)), F.col("n")).otherwise(0).alias("fn")), F.struct(F.col("pred").alias("label"), F.lit(0).cast("long").alias("tp"), F.when(F.col("gold") != F.col("pred"), F.col("n")).otherwise(0).alias("fp"), F.lit(0).cast("long").alias("fn"))))
    rows = conf.select(*keys, sides.alias("s")).select(*keys, "s.*").where("label is not null")
    out = rows.groupBy(*keys, "label").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    return out.withColumn("f1", F.when(F.col("tp") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0))


def macro_f1(conf: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return class_scores(conf, keys).groupBy(*(keys or [])).agg(F.avg("f1").alias("macro_f1"), F.count("*").alias("n_classes"))


def protocol_rates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Shares of verdicts, extra text, loops and ends, accuracy over gold rows, and recall of UNKNOWN (null without such gold)."""
    n = F.count("*")
    gold = F.col("gold").isNotNull()
    unknown = F.count_if(F.col("gold") == "UNKNOWN")
    return rows.groupBy(*keys).agg(
        n.alias("n_samples"), (F.count_if(F.col("verdict") == "STRICT") / n).alias("strict_valid"), (F.count_if(F.col("verdict").isin("STRICT", "REPAIRABLE")) / n).alias("repairable_valid"), (F.count_if(F.col("verdict") == "OUT_OF_CANDIDATE") / n).alias("out_of_candidate"),
        F.count_if(gold).alias("gold_subset"), ratio(F.count_if(gold & F.col("gold").eqNullSafe(F.col("pred"))), F.count_if(gold)).alias("gold_accuracy"), F.when(unknown > 0, F.count_if((F.col("gold") == "UNKNOWN") & (F.col("pred") == "UNKNOWN")) / unknown).alias("unknown_recall"),
        ratio(F.count_if(~gold & (F.col("pred") == "UNKNOWN")), F.count_if(~gold)).alias("unknown_on_ungolded"),
    )


def identity_errors(rows: DataFrame, keys: list[str]) -> DataFrame:
    """False merges and splits by gold class, the 5 to 1 weighted error, and hard negatives called the same."""
    both = lambda g, p: F.count_if((F.col("gold") == g) & (F.col("pred") == p))
    merge, split = both("DIFFERENT", "SAME"), both("SAME", "DIFFERENT")
    hard = F.coalesce("hard_block", F.lit(False)) & F.col("gold").isNotNull()
    return rows.groupBy(*keys).agg(
        ratio(merge, F.count_if(F.col("gold") == "DIFFERENT")).alias("false_merge_rate"), ratio(split, F.count_if(F.col("gold") == "SAME")).alias("false_split_rate"), (5 * merge + split).alias("weighted_identity_error"), ratio(F.count_if(hard & (F.col("pred") == "SAME")), F.count_if(hard)).alias("hard_negative_violation"),
    )


def by_cardinality(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Accuracy, violations and unknowns by the number of candidates k."""
    n = F.count("*")
    return rows.groupBy(*(keys or []), F.size("candidates").alias("k")).agg(
        n.alias("n"), (F.count_if(F.col("pred") == F.col("gold")) / n).alias("accuracy"), (F.count_if(F.col("pred").isNotNull() & (F.col("pred") != "UNKNOWN") & ~F.array_contains("candidates", F.col("pred"))) / n).alias("violations"), (F.count_if(F.col("pred") == "UNKNOWN") / n).alias("unknown"),
    )


def permutation_consistency(rows: DataFrame) -> Column:
    """All predictions of a row's permutations are equal, and equal to gold."""
    return (F.size(F.array_distinct("perm_preds")) == 1) & (F.try_element_at("perm_preds", F.lit(1)) == F.col("gold"))


def recall_at(rows: DataFrame, ks: list[int], keys: list[str] | None = None) -> DataFrame:
    """Recall at each k, mean and p95 of the gold's rank, and sizes. ``rows`` has gold_rank (null: not among the candidates) and size."""
    n = F.count("*")
    return rows.groupBy(*(keys or [])).agg(n.alias("n"), *(F.coalesce(F.count_if(F.col("gold_rank") <= k) / n, F.lit(0.0)).alias(f"recall_at_{k}") for k in ks), F.avg("gold_rank").alias("rank_mean"), F.avg("size").alias("size_mean"), F.median("size").alias("size_median"), F.max("size").alias("size_max"))


RANGES = 1024


def gold_ranks(rows: DataFrame) -> DataFrame:
    """Rows with a gold (column gold; the rest are left out) with gold_rank, its place from 1 in the array ``store`` of (surface, source), null if it isn't there, and size."""
    place = F.array_position(F.transform("store", lambda c: c["surface"]), F.col("gold"))
    return rows.where(F.col("gold").isNotNull()).withColumn("gold_rank", F.nullif(place, F.lit(0)).cast("int")).withColumn("size", F.size("store"))


def store_report(rows: DataFrame, ks: list[int], keys: list[str]) -> DataFrame:
    """By key: n, recall at each k and of the whole store, median and p95 of the size by index; ``rows`` as ``gold_ranks`` gives them. Equal keys meet, nulls too."""
    share = lambda cond: F.round(F.count_if(cond) / F.count("*"), 6)
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"), *(share(F.col("gold_rank") <= k).alias(f"recall_{k}") for k in ks), share(F.col("gold_rank").isNotNull()).alias("recall_all"))
    sizes = nearest_rank(rows, "size", {"size_p50": 0.5, "size_p95": 0.95}, keys).select(*(F.col(k).alias(f"__{k}") for k in keys), "size_p50", "size_p95")
    same = reduce(lambda x, k: x & F.col(k).eqNullSafe(F.col(f"__{k}")), keys, F.lit(True))
    return counts.join(sizes, same).drop(*(f"__{k}" for k in keys))


def nearest_rank(rows: DataFrame, value: str, shares: dict[str, float], keys: list[str]) -> DataFrame:
    """Percentiles by index floor(share * n), capped at the last, in ascending order; not interpolated. Nulls are left out.

    Each key's values are dealt into ranges between its least and its greatest; counts of the ranges tell in which one
    each percentile lies, and only the values of those ranges are ordered.
    """
    names = [f"__k{i}" for i in range(len(keys))]
    given = rows.where(F.col(value).isNotNull()).select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), F.col(value).alias("v"))
    ends = given.groupBy(*names).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    width = (F.col("hi").cast("double") - F.col("lo").cast("double")) / RANGES
    part = F.when(width > 0, F.least(F.floor((F.col("v").cast("double") - F.col("lo").cast("double")) / width), F.lit(RANGES - 1))).otherwise(0)

    def meet(left: DataFrame, right: DataFrame, also: list[str]) -> DataFrame:
        """Rows of both sides with equal keys, nulls being equal."""
        side = right.select(*(F.col(n).alias(f"{n}_") for n in [*names, *also]), *(c for c in right.columns if c not in [*names, *also]))
        return left.join(side, reduce(lambda x, n: x & F.col(n).eqNullSafe(F.col(f"{n}_")), [*names, *also], F.lit(True))).drop(*(f"{n}_" for n in [*names, *also]))

    dealt = meet(given, ends, []).select(*names, "v", part.alias("part"))
    w = W.partitionBy(*names).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    counts = dealt.groupBy(*names, "part").agg(F.count("*").alias("c")).withColumn("before", F.coalesce(F.sum("c").over(w), F.lit(0))).withColumn("n", F.sum("c").over(W.partitionBy(*names)))
    wanted = F.array(*(F.struct(F.lit(name).alias("name"), F.least(F.floor(F.lit(p) * F.col("n")), F.col("n") - 1).alias("index")) for name, p in shares.items()))
    asked = counts.select(*names, "part", "before", "c", "n", F.explode(wanted).alias("w")).where((F.col("w.index") >= F.col("before")) & (F.col("w.index") < F.col("before") + F.col("c")))
    found = asked.select(*names, "part", "n", F.col("w.name").alias("name"), (F.col("w.index") - F.col("before")).alias("index"))
    inner = meet(dealt, found.select(*names, "part").distinct(), ["part"]).groupBy(*names, "part", "v").agg(F.count("*").alias("c"))
    upto = inner.withColumn("upto", F.sum("c").over(W.partitionBy(*names, "part").orderBy("v").rowsBetween(W.unboundedPreceding, 0))).drop("c")
    met = meet(found, upto, ["part"]).where("upto > index")
    out = met.groupBy(*names).agg(F.max("n").alias("n"), *(F.min(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in shares))
    return out.select(*(F.col(n).alias(k) for k, n in zip(keys, names, strict=True)), "n", *shares)


def latency_summary(rows: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Median by index n // 2 and p95 by floor(0.95 n)."""
    return nearest_rank(rows, value, {"median": 0.5, "p95": 0.95}, keys)


def token_rates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Tokens read and written a second of all calls together, and on average; ``rows`` has tokens_in, tokens_out and seconds. No time gives null rates."""
    rate = lambda c: F.round(F.try_divide(F.sum(c), F.sum("seconds")), 1)
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), rate("tokens_in").alias("prompt_tokens_s"), rate("tokens_out").alias("generation_tokens_s"), F.round(F.avg("tokens_in"), 0).alias("avg_input_tokens"), F.round(F.avg("tokens_out"), 0).alias("avg_output_tokens"))


def error_class(gold: Column, pred: Column, candidates: Column) -> Column:
    """What kind of error a labelled prediction is."""
    return (
        F.when(gold == pred, "CORRECT").when(pred.isNull(), "MISSING").when(pred == "UNKNOWN", "ABSTAINED").when(gold == "UNKNOWN", "INVENTED").when(~F.array_contains(candidates, gold), "GOLD_NOT_OFFERED")
        .when(~F.array_contains(candidates, pred), "OUT_OF_CANDIDATE").otherwise("WRONG_CANDIDATE")
    )


def judged(rows: DataFrame, top: int = 10) -> tuple[DataFrame, DataFrame]:
    """(counts by error class, the most frequent confusions) over labelled rows; refuses when none is labelled."""
    labelled = rows.where("gold is not null")
    if not labelled.limit(1).count():
        raise ValueError("no labelled row")
    kinds = labelled.groupBy(error_class(F.col("gold"), F.col("pred"), F.col("candidates")).alias("error")).agg(F.count("*").alias("n"))
    pairs = confusion(labelled.where("not (gold <=> pred)")).orderBy(F.col("n").desc(), "gold", "pred").limit(top)
    return kinds, pairs


def two_level_counts(rows: DataFrame, outer: str, inner: str) -> DataFrame:
    """Counts by both, by the outer alone and in all: rollup, with ALL in place of the missing level."""
    got = rows.groupBy(outer, inner).agg(F.count("*").alias("n")).select(F.coalesce(F.col(outer).cast("string"), F.lit("")).alias(outer), F.coalesce(F.col(inner).cast("string"), F.lit("")).alias(inner), "n")
    return got.rollup(outer, inner).agg(F.sum("n").alias("n")).select(F.coalesce(outer, F.lit("ALL")).alias(outer), F.coalesce(inner, F.lit("ALL")).alias(inner), "n")


def agreement_by_kind(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Agreement with the judge and stability over repeats. ``rows`` has answer, judge and repeats (array)."""
    n = F.count("*")
    return rows.groupBy(*keys).agg(n.alias("n"), (F.count_if(F.col("answer") == F.col("judge")) / n).alias("agreement"), (F.count_if(F.size(F.array_distinct("repeats")) == 1) / n).alias("stability"))


def judge_counters(rows: DataFrame, keys: list[str]) -> DataFrame:
    """How many answers pass each check: parsed, the asked id returned, a speaker among the candidates or UNKNOWN, evidence among what was given, all repeats equal, and UNKNOWN.

    ``rows`` has parsed, asked, answered, speaker, candidates, evidence, given and repeats. Answers that weren't parsed pass
    none of the others; no evidence is fine.
    """
    ok = F.coalesce(F.col("parsed"), F.lit(False))
    none = F.array().cast("array<string>")
    checks = {
        "p1_parsed": F.lit(True), "p2_id": F.col("answered").eqNullSafe(F.col("asked")), "p3_speaker": (F.col("speaker") == "UNKNOWN") | F.array_contains("candidates", F.col("speaker")),
        "p4_evidence": F.size(F.array_except(F.coalesce("evidence", none), F.coalesce("given", none))) == 0, "p5_stable": F.size(F.array_distinct("repeats")) == 1, "p6_unknown": F.col("speaker") == "UNKNOWN",
    }
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *(F.count_if(ok & c).alias(name) for name, c in checks.items()))


def gate_probe(gated: DataFrame, labels: DataFrame) -> DataFrame:
    """Surfaces by their label (name, or fragment where none says so) and the gate's verdict: label, reason (ACCEPTED, or why not), n, and the share of the label that was decided right."""
    met = gated.join(labels.select("surface").where("label = 'name'").distinct().withColumn("__name", F.lit(True)), "surface", "left")
    rows = met.select(F.when(F.col("__name"), "name").otherwise("fragment").alias("label"), F.coalesce("reject", F.lit("ACCEPTED")).alias("reason"))
    counts = rows.groupBy("label", "reason").agg(F.count("*").alias("n"))
    right = (F.col("label") == "name") == (F.col("reason") == "ACCEPTED")
    w = W.partitionBy("label")  # a row for each reason
    return counts.withColumn("right_share", F.round(F.sum(F.when(right, F.col("n")).otherwise(0)).over(w) / F.sum("n").over(w), 6))


def nonperson_speakers(lines: DataFrame, rejected: DataFrame) -> DataFrame:
    """Lines by speakers that the name gate rejected: speaker, n (a semi-join, then a count)."""
    return lines.join(rejected.select(F.col("surface").alias("speaker")).distinct(), "speaker", "left_semi").groupBy("speaker").agg(F.count("*").alias("n"))


def gate_invariants(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Counts of broken invariants of a run: missing fields, leaked control text, span lengths, order."""
    w = W.partitionBy(*keys).orderBy(seq)
    marked = rows.withColumn("__back", F.coalesce(F.lag("span_start").over(w) > F.col("span_start"), F.lit(False)))
    return marked.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("text").isNull() | F.col("speaker").isNull()).alias("n_missing"), F.count_if(F.col("text").rlike(r"```|\{\"|<\|")).alias("n_leaks"), F.count_if(F.length("text") != F.col("span_end") - F.col("span_start")).alias("n_span"), F.count_if("__back").alias("n_order"))


def signal_histogram(rows: DataFrame, signals: dict[str, Column]) -> DataFrame:
    """Rows by their number of signals, and how often each signal is among them."""
    flags = {k: F.coalesce(c, F.lit(False)).cast("int") for k, c in signals.items()}
    scored = rows.select(*(f.alias(k) for k, f in flags.items())).withColumn("score", sum((F.col(k) for k in flags), F.lit(0)))
    return scored.groupBy("score").agg(F.count("*").alias("n"), *(F.sum(k).alias(k) for k in flags))


def mention_scores(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Micro precision and recall of predicted mention sets."""
    hit = F.sum(F.size(F.array_intersect("gold_mentions", "pred_mentions")))
    gold, pred = F.sum(F.size(F.array_distinct("gold_mentions"))), F.sum(F.size(F.array_distinct("pred_mentions")))
    return rows.groupBy(*keys).agg(hit.alias("hit"), gold.alias("gold"), pred.alias("pred"), ratio(hit, pred).alias("precision"), ratio(hit, gold).alias("recall"))


def binding_scores(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Owner, reference and joint accuracy; a null gold is no part of its denominator. Precision and recall of UNKNOWN owners."""
    owner, ref = F.col("gold_owner").isNotNull(), F.col("gold_ref").isNotNull()
    same_owner, same_ref = F.col("gold_owner").eqNullSafe(F.col("pred_owner")), F.col("gold_ref").eqNullSafe(F.col("pred_ref"))
    unknown = lambda c: F.coalesce(F.col(c) == "UNKNOWN", F.lit(False))
    tp = F.count_if(unknown("gold_owner") & unknown("pred_owner"))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), ratio(F.count_if(owner & same_owner), F.count_if(owner)).alias("owner_accuracy"), ratio(F.count_if(ref & same_ref), F.count_if(ref)).alias("ref_accuracy"), ratio(F.count_if(owner & ref & same_owner & same_ref), F.count_if(owner & ref)).alias("joint_accuracy"),
        ratio(tp, F.count_if(unknown("pred_owner"))).alias("unknown_precision"), ratio(tp, F.count_if(unknown("gold_owner"))).alias("unknown_recall"),
    )


def pollution_audit(rows: DataFrame, classes: list[tuple[str, Column]]) -> DataFrame:
    """Counts by the first class that a candidate falls in; CLEAN if none."""
    first = F.coalesce(*(F.when(cond, F.lit(name)) for name, cond in classes), F.lit("CLEAN"))
    return rows.groupBy(first.alias("reason")).agg(F.count("*").alias("n"))


def regex_totals(docs: DataFrame, patterns: dict[str, str], text_col: str = "text") -> DataFrame:
    """Corpus totals of each pattern's matches, in one aggregate."""
    return docs.agg(*(F.coalesce(F.sum(F.regexp_count(text_col, F.lit(p))), F.lit(0)).alias(name) for name, p in patterns.items()))


def metric_deltas(metrics: DataFrame, base: str, name: str = "run") -> DataFrame:
    """Each run's metrics less those of the base run; missing values stay null. ``metrics`` has run, metric, value."""
    ref = metrics.where(F.col(name) == base).select("metric", F.col("value").alias("base_value"))
    return metrics.join(ref, "metric", "left").withColumn("delta", F.col("value") - F.col("base_value"))


def entity_frequency(rows: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """Counts of each name that reach the gate."""
    return rows.groupBy(*keys, "name").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def distinct_counts(rows: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """Exact numbers of distinct values of each column, nulls aside, in all or by key."""
    return rows.groupBy(*(keys or [])).agg(*(F.count_distinct(c).alias(f"n_{c}") for c in columns))
