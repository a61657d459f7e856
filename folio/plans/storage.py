"""Queries on stores: package import and the replay of recorded calls."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.checkpoints import checkpoint_dir
from folio.operators import replay, sampling, segments
from folio.plans.base import query, table
from folio.sources import packages, sinks

FILES = """f AS (SELECT CASE WHEN lang = 'en' THEN 'first' ELSE 'second' END AS batch, lpad(doc_id::VARCHAR, 12, '0') || '.txt' AS source_name, 'chars-' || length(text) AS book_id, sha256(text) AS sha256, strlen(text) AS bytes FROM documents),
j AS (SELECT *, first_value(sha256) OVER w AS first, row_number() OVER w AS k FROM f WINDOW w AS (PARTITION BY book_id ORDER BY batch, source_name, sha256))"""


def imported(spark: SparkSession, sf_dir: str) -> str:
    """All documents as files, named by their length, imported in two batches: the English ones, then the others."""
    root = f"{checkpoint_dir(spark)}/packages-{uuid4().hex}"
    files = table(spark, sf_dir, "documents").select("lang", F.concat(F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit(".txt")).alias("source_name"), F.concat(F.lit("chars-"), F.length("text")).alias("book_id"), F.col("text").cast("binary").alias("content"))
    packages.import_files(spark, files.where("lang = 'en'").drop("lang"), root, "first")
    packages.import_files(spark, files.where("lang is null or lang <> 'en'").drop("lang"), root, "second")
    return root


@query(f"WITH {FILES} SELECT batch, source_name, book_id, sha256, CASE WHEN k = 1 THEN 'NEW' WHEN first = sha256 THEN 'DUPLICATE' ELSE 'COLLISION' END AS outcome FROM j")
def package_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each file: stored, known with the same bytes, or refused because its id has others."""
    return packages.outcomes(spark, imported(spark, sf_dir)).select("batch", "source_name", "book_id", "sha256", "outcome")


@query(f"WITH {FILES} SELECT book_id, source_name, split_part(source_name, '.', 1) AS title, sha256, bytes::BIGINT AS bytes, batch, sha256 AS read_sha256 FROM j WHERE k = 1")
def package_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of each stored package, and the digest of its bytes as they are read back."""
    root = imported(spark, sf_dir)
    read = packages.contents(spark, root).select("book_id", F.sha2("content", 256).alias("read_sha256"))
    return packages.stored(spark, root).join(read, "book_id").select("book_id", "source_name", "title", "sha256", "bytes", "batch", "read_sha256")


CALLS = """e AS (SELECT user_id AS run, event_id AS "at", event_type AS store, hour(ts) AS h, dayofweek(ts) IN (0, 6) AS weekend FROM events),
a AS (SELECT *, row_number() OVER (PARTITION BY run, store, h ORDER BY "at") AS nth FROM e), l AS (SELECT run, store, h, list("at" ORDER BY "at") AS got FROM e WHERE NOT weekend GROUP BY ALL),
r AS (SELECT run, "at", store, nth, got[nth] AS result, CASE WHEN got IS NULL THEN 'MISSING' WHEN nth > len(got) THEN 'EXHAUSTED' ELSE 'HIT' END AS outcome FROM a LEFT JOIN l USING (run, store, h))"""


def replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as calls for an hour of the day: those of weekdays are recorded, and all are answered from that record."""
    calls = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("at"), F.col("event_type").alias("store"), F.lit("hour").alias("method"), F.hour("ts").alias("h"), F.dayofweek("ts").isin(1, 7).alias("weekend"))
    log = replay.record(calls.where("not weekend").withColumn("got", F.col("at")), ["h"], "got")
    return replay.replay(calls, log, ["h"])


@query(f"WITH {CALLS} SELECT run, \"at\", store, nth::INT AS nth, result, outcome FROM r")
def replayed_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer to each call, by how many equal ones its run has made before."""
    return replayed(spark, sf_dir).select("run", "at", "store", "nth", "result", "outcome")


@query(f"WITH {CALLS} SELECT run, count(*) AS calls, count(*) FILTER (outcome = 'HIT') AS hits, min(\"at\") FILTER (outcome <> 'HIT') AS first_at, arg_min(store, \"at\") FILTER (outcome <> 'HIT') AS first_store, arg_min(outcome, \"at\") FILTER (outcome <> 'HIT') AS first_outcome FROM r GROUP BY run")
def replay_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each run first leaves its record."""
    return replay.divergences(replayed(spark, sf_dir)).drop("first_method")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, dense_rank() OVER (ORDER BY l_partkey, l_suppkey) AS pair_id FROM lineitem")
def dense_pair_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with the number of their part and supplier among all such pairs."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return sinks.with_dense_key(rows, "pair_id", "l_partkey", "l_suppkey")


@query("SELECT count(*) AS n_keys, 0::BIGINT AS shared, 0::BIGINT AS missing, 0::BIGINT AS below FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)")
def dense_key_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """That the numbers of the pairs are unique and dense."""
    return sinks.key_faults(sinks.dense_keys(table(spark, sf_dir, "lineitem"), "pair_id", "l_partkey", "l_suppkey"), "pair_id")


@query(
    """WITH m AS (SELECT conv_id, turn, text, nullif(role, 'user') AS speaker, regexp_extract_all(text, '[A-Z][a-z]+') AS mentions FROM conversations),
    a AS (SELECT conv_id, turn, array_agg(sha256(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS previous,
        list_filter(array_agg(speaker) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), lambda x: x IS NOT NULL) AS s,
        flatten(array_agg(mentions) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS f FROM m)
    SELECT conv_id, turn, coalesce(array_to_string(previous, ','), '') AS previous, coalesce(array_to_string(s[-3:], ','), '') AS recent_speakers, array_to_string(f[-6:], ',') AS recent_mentions FROM a"""
)
def causal_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each turn the five texts before it (as digests), the last three speakers who aren't the user, and the last six capitalised words."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(F.col("text").cast("binary"), 256).alias("sha"), F.nullif("role", F.lit("user")).alias("speaker"), F.regexp_extract_all("text", F.lit("([A-Z][a-z]+)"), F.lit(1)).alias("mentions"))
    made = segments.causal_lists(rows, ["conv_id"], ["turn"], "sha", "speaker", "mentions")
    return made.select("conv_id", "turn", *(F.array_join(c, ",").alias(c) for c in ("previous", "recent_speakers", "recent_mentions")))


@query(
    """WITH k AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'DONE' ELSE 'OPEN' END AS kind FROM orders),
    r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, kind ORDER BY o_orderkey) AS rn, count(*) FILTER (kind = 'DONE') OVER (PARTITION BY o_custkey) AS d, count(*) FILTER (kind = 'OPEN') OVER (PARTITION BY o_custkey) AS o FROM k)
    SELECT o_custkey, o_orderkey, kind FROM r WHERE rn <= CASE kind WHEN 'DONE' THEN 7 + greatest(0, 3 - o) ELSE 3 + greatest(0, 7 - d) END"""
)
def filled_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten orders of each customer, seven done and three open ones; where one kind falls short, more of the other."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    kind = F.when(F.col("o_orderstatus") == "F", "DONE").otherwise("OPEN")
    return sampling.filled_quota(rows, ["o_custkey"], kind, {"DONE": 7, "OPEN": 3}, ["o_orderkey"]).select("o_custkey", "o_orderkey", "kind")
