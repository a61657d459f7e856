"""Record and replay of calls: a log keyed by store, method, arguments and which call with these it was."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def numbered(calls: DataFrame, args: list[str], run: str = "run", at: str = "at") -> DataFrame:
    """``calls`` (run, at, store, method, the arguments) with args_hash and nth, from 1 for each equal call of a run, in order of ``at``.

    Null arguments are arguments of their own: a null and an empty string give different hashes.
    """
    told = F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("="), F.col(a).cast("string")), F.lit("-")) for a in args))
    keyed = calls.withColumn("args_hash", F.sha2(told.cast("binary"), 256))
    return keyed.withColumn("nth", F.row_number().over(W.partitionBy(run, "store", "method", "args_hash").orderBy(at)))


def record(calls: DataFrame, args: list[str], result: str, run: str = "run", at: str = "at") -> DataFrame:
    """run, store, method, args_hash, nth, result: the log of what calls gave."""
    return numbered(calls, args, run, at).select(run, "store", "method", "args_hash", "nth", F.col(result).alias("result"))


def replay(calls: DataFrame, log: DataFrame, args: list[str], result: str | None = None, run: str = "run", at: str = "at") -> DataFrame:
    """Calls answered from the log: run, at, store, method, nth, result, outcome.

    HIT has the recorded result, EXHAUSTED means that the log knows the call but fewer times, and MISSING that it doesn't.
    Where the calls have a ``result`` of their own, a hit that differs from it is a MISMATCH.
    """
    asked = numbered(calls, args, run, at)
    keys = [run, "store", "method", "args_hash"]
    met = asked.join(log.select(*keys, "nth", F.struct("result").alias("held")), [*keys, "nth"], "left")
    met = met.join(log.where("nth = 1").select(*keys, F.lit(True).alias("known")), keys, "left")
    differs = F.lit(False) if result is None else ~F.col("held.result").eqNullSafe(F.col(result))
    outcome = F.when(F.col("held").isNull(), F.when(F.col("known"), "EXHAUSTED").otherwise("MISSING")).when(differs, "MISMATCH").otherwise("HIT")
    return met.select(run, at, "store", "method", "nth", F.col("held.result").alias("result"), outcome.alias("outcome"))


def divergences(replayed: DataFrame, run: str = "run", at: str = "at") -> DataFrame:
    """One row for each run: calls, hits, and the first call that isn't a hit (null where all are)."""
    bad = F.when(F.col("outcome") != "HIT", F.struct(F.col(at).alias("at"), "store", "method", "outcome"))
    out = replayed.groupBy(run).agg(F.count("*").alias("calls"), F.count_if(F.col("outcome") == "HIT").alias("hits"), F.min(bad).alias("first"))
    return out.select(run, "calls", "hits", F.col("first.at").alias("first_at"), F.col("first.store").alias("first_store"), F.col("first.method").alias("first_method"), F.col("first.outcome").alias("first_outcome"))
