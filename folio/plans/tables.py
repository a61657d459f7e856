"""Queries on events, orders and line items: state, as-of joins, integrity, versions, queues, graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.operators import asof, blocks, decisions, evaluation, identity, integrity, render, state, versions
from folio.plans.base import query, table

MICROS = "epoch_us(ts)"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their position: microseconds since the epoch."""
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("entity"), F.unix_micros(F.col("ts").cast("timestamp")).alias("position"), "event_type", "value", "props")


@query(
    f"""WITH e AS (SELECT event_id, user_id AS entity, {MICROS} AS position, event_type, value FROM events), f AS (SELECT * FROM e WHERE event_type IN ('signup', 'purchase')), p AS (SELECT * FROM e WHERE event_type IN ('click', 'view'))
    SELECT p.event_id, p.entity, (SELECT arg_max(f.event_id, (f.position, f.event_id)) FROM f WHERE f.entity = p.entity AND f.position <= p.position) AS asof_event_id FROM p"""
)
def asof_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phase at each click or view: a user's last sign-up or purchase by then."""
    e = positions(spark, sf_dir)
    got = asof.asof_last(e.where("event_type in ('click', 'view')").select("event_id", "entity", "position"), e.where("event_type in ('signup', 'purchase')").withColumn("tie", F.col("event_id")).withColumn("fact_id", F.col("event_id")), "entity", "position", ["fact_id"], tie="tie")
    return got.select("event_id", "entity", F.col("asof_fact_id").alias("asof_event_id"))


@query(
    f"""WITH e AS (SELECT event_id, user_id AS entity, {MICROS} AS position, event_type, round(value, 4) AS value FROM events), p AS (SELECT entity, max(position) AS position FROM e GROUP BY entity)
    SELECT p.entity, p.position, e.event_type, arg_max(e.value, (CASE WHEN e.event_type = 'signup' THEN NULL ELSE e.position END IS NOT NULL, coalesce(CASE WHEN e.event_type = 'signup' THEN NULL ELSE e.position END, -1), e.event_id)) AS value FROM p JOIN e USING (entity) GROUP BY ALL"""
)
def causal_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest value of every event type by a user's last event; sign-up values are known without a position."""
    e = positions(spark, sf_dir).withColumn("value", F.round("value", 4)).withColumn("known_at", F.when(F.col("event_type") != "signup", F.col("position")))
    points = e.groupBy("entity").agg(F.max("position").alias("position"))
    return asof.visible_attributes(points, e.select("entity", "event_type", "value", "known_at", "event_id"), "entity", "position", "event_type", "value", "known_at", "event_id")


INTERVALS = f"""e AS (SELECT event_id, user_id AS entity, {MICROS} AS position, event_type FROM events), i AS (SELECT entity, event_id AS iid, position AS s, CASE WHEN event_id % 5 = 0 THEN NULL ELSE position + 3600000000 * (event_id % 90) END AS t FROM e WHERE event_type = 'signup' OR event_type = 'error'), p AS (SELECT * FROM e WHERE event_type = 'purchase')"""


@query(
    f"""WITH {INTERVALS} SELECT p.event_id, p.entity, (SELECT arg_max(iid, (s, iid)) FROM i WHERE i.entity = p.entity AND s <= position AND position <= coalesce(t, 9e18)) AS held_iid, (SELECT arg_max(iid, (s, iid)) FROM i WHERE i.entity = p.entity AND s <= position AND position < coalesce(t, 9e18)) AS open_iid FROM p"""
)
def interval_stab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interval that holds each purchase, with its end in it and without; the latest start wins."""
    e = positions(spark, sf_dir)
    spans = e.where("event_type in ('signup', 'error')").select("entity", F.col("event_id").alias("iid"), F.col("position").alias("s"), F.when(F.col("event_id") % 5 != 0, F.col("position") + 3_600_000_000 * (F.col("event_id") % 90)).alias("t"))
    points = e.where("event_type = 'purchase'").select("event_id", "entity", "position")
    closed = asof.stab(points, spans, "entity", "position", "s", "t", ["iid"], tie="iid")
    half = asof.stab(closed, spans.withColumnRenamed("iid", "oid"), "entity", "position", "s", "t", ["oid"], closed=False, tie="oid")
    return half.select("event_id", "entity", "held_iid", F.col("held_oid").alias("open_iid"))


CONTROL = f"""c AS (SELECT user_id AS entity, {MICROS} AS position, event_id, CASE WHEN event_type = 'error' THEN 'CLEAR' ELSE 'SET' END AS operation, CASE event_type WHEN 'click' THEN 'UNKNOWN' ELSE event_type END AS style, CASE WHEN value > 50 THEN 'high' ELSE 'UNKNOWN' END AS target FROM events),
k AS (SELECT *, CASE WHEN operation = 'SET' THEN coalesce(nullif(style, 'UNKNOWN'), nullif(target, 'UNKNOWN'), 'UNKNOWN') END AS temp_key FROM c), b AS (SELECT *, lag(temp_key) OVER (PARTITION BY entity ORDER BY position, event_id) AS before FROM k),
a AS (SELECT *, CASE WHEN temp_key IS NOT NULL THEN CASE WHEN before IS NULL THEN 'START' WHEN before = temp_key THEN 'CONTINUE' ELSE 'REPLACE' END WHEN before IS NOT NULL THEN 'END' ELSE 'NONE' END AS action FROM b)"""


def controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as control events: errors clear, all others set; the style is the type, the target follows the value."""
    e = positions(spark, sf_dir)
    return e.select("entity", "position", "event_id", F.when(F.col("event_type") == "error", "CLEAR").otherwise("SET").alias("operation"), F.when(F.col("event_type") == "click", "UNKNOWN").otherwise(F.col("event_type")).alias("style"), F.when(F.col("value") > 50, "high").otherwise("UNKNOWN").alias("target"))


@query(f"WITH {CONTROL} SELECT entity, event_id, temp_key, action FROM a")
def state_reducer_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.reduce_overrides(controls(spark, sf_dir), ["entity"], ["position", "event_id"]).select("entity", "event_id", "temp_key", "action")


@query(
    f"""WITH {CONTROL}, m AS (SELECT entity, position, event_id, action, temp_key, lead(position) OVER (PARTITION BY entity ORDER BY position, event_id) AS end_at FROM a WHERE action IN ('START', 'REPLACE', 'END'))
    SELECT entity, position AS start_at, end_at, 'OVERRIDE' AS state_type, temp_key AS descriptor FROM m WHERE action <> 'END' UNION ALL SELECT entity, position, position, 'ORPHAN_CLEAR', NULL FROM a WHERE action = 'NONE'"""
)
def state_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    acts = state.reduce_overrides(controls(spark, sf_dir), ["entity"], ["position", "event_id"])
    acts = acts.withColumn("action", F.when(F.col("action") == "NONE", "ORPHAN_CLEAR").otherwise(F.col("action"))).withColumn("override", F.col("temp_key"))
    return state.timeline(acts, ["entity"], "position", "event_id")


@query()
def voice_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layered engine over each user's events: clicks are performances and every fourth override lasts one utterance. Expiry uses up an event, so there is no SQL."""
    c = controls(spark, sf_dir)
    rows = c.withColumn("kind", F.when(F.col("style") == "UNKNOWN", "PERFORMANCE").otherwise("VOICE_OVERRIDE")).withColumn("scope", F.when(F.col("event_id") % 4 == 0, "UTTERANCE").otherwise("UNTIL_CLEAR"))
    return state.run_engine(rows, ["entity"], ["position", "event_id"])


@query("WITH d AS (SELECT event_id, try_cast(regexp_extract(props, '\"k\":\\s*(-?\\d+)', 1) AS BIGINT) AS k FROM events) SELECT event_id, k, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'JSON_OBJECT_EXTRACTED' WHEN 2 THEN 'TRAILING_COMMA' ELSE 'CODE_FENCE_STRIPPED,JSON_OBJECT_EXTRACTED' END AS fixes FROM d")
def props_json_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Props damaged in four ways by event id, cut out and repaired: the value is read back and the repairs are named."""
    k = F.col("event_id") % 4
    raw = F.when(k == 0, F.col("props")).when(k == 1, F.concat(F.lit("answer: "), F.col("props"), F.lit(" ok"))).when(k == 2, F.regexp_replace("props", r"\}\s*$", ",}")).otherwise(F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```")))
    text, fixes = decisions.repair_json(F.col("raw"))
    rows = table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))
    return rows.select("event_id", F.get_json_object(text, "$.k").try_cast("long").alias("k"), F.array_join(fixes, ",").alias("fixes"))


@query("WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, n, min(value) FILTER (i = least(floor(0.5 * n), n - 1)) AS median, min(value) FILTER (i = least(floor(0.95 * n), n - 1)) AS p95 FROM s GROUP BY ALL")
def nearest_rank_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.latency_summary(table(spark, sf_dir, "events"), "value", ["event_type"])


@query("SELECT user_id, event_type, min(ts) AS from_ts, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g FROM events) GROUP BY user_id, event_type, g HAVING count(*) >= 2")
def event_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one event type of a user."""
    rows = blocks.islands(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type").where("event_type is not null")
    return rows.groupBy("user_id", "event_type", "island").agg(F.min("ts").alias("from_ts"), F.count("*").alias("n")).where("n >= 2").drop("island")


@query("WITH b AS (SELECT * FROM orders WHERE o_orderkey % 10 <> 0) SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM b) GROUP BY ALL")
def fk_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items whose order was lost: every tenth order is taken away first."""
    kept = table(spark, sf_dir, "orders").where("o_orderkey % 10 <> 0")
    return integrity.orphans(table(spark, sf_dir, "lineitem").select("l_orderkey"), kept, "l_orderkey", "o_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY ALL HAVING count(*) > 1")
def dup_actives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.duplicate_groups(table(spark, sf_dir, "orders").where("o_orderstatus = 'O'"), ["o_custkey", "o_orderpriority"])


@query("SELECT l_orderkey, count(*) AS n, max(l_linenumber) AS top FROM lineitem GROUP BY ALL HAVING count(*) <> max(l_linenumber)")
def span_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.span_gaps(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber", base=1)


@query("SELECT l_orderkey, l_linenumber, l_suppkey FROM (SELECT *, lag((l_shipdate, l_suppkey)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS b FROM lineitem) WHERE (l_shipdate, l_suppkey) < b")
def monotone_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    rows = table(spark, sf_dir, "lineitem").withColumn("seq", F.row_number().over(w))
    return integrity.monotone_breaks(rows, ["l_orderkey"], "seq", ["l_shipdate", "l_suppkey"]).select("l_orderkey", "l_linenumber", "l_suppkey")


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in TABLES))
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.table_counts(spark, {t: table(spark, sf_dir, t) for t in TABLES})


@query("SELECT * FROM (SELECT o_custkey, o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O') QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) = 1")
def claim_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next open order of each customer by priority, then age."""
    jobs = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_custkey", "o_orderkey", "o_orderpriority", F.col("o_orderkey").alias("job_id"), F.col("o_orderpriority").alias("priority"), F.col("o_orderkey").alias("updated_at"), F.lit("PLANNED").alias("state"), F.lit(0).alias("not_before"))
    return render.claim(jobs, F.lit(0), ["o_custkey"]).select("o_custkey", "o_orderkey", "o_orderpriority")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 OR o_orderstatus <> 'F' OR o_custkey % 9 = 0 OR o_orderkey % 13 < 3 THEN 'MISS' WHEN o_orderkey % 13 - 3 >= o_custkey % 8 THEN 'HIT' ELSE 'EXTEND' END AS verdict, concat_ws(',', CASE WHEN o_orderkey % 6 = 0 THEN 'NO_STATE' END, CASE WHEN o_orderkey % 6 <> 0 AND o_orderstatus <> 'F' THEN 'SOURCE_CHANGED' END, CASE WHEN o_custkey % 9 = 0 THEN 'NAMES_CHANGED' END, CASE WHEN o_orderkey % 13 < 3 THEN 'NOTHING_PREPARED' END) AS reasons FROM orders")
def cache_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts over orders read as script states."""
    have = F.when(F.col("o_orderkey") % 6 != 0, F.col("o_orderstatus"))
    v = versions.cache_verdict(have, F.lit("F"), (F.col("o_custkey") % 9 == 0).cast("string"), F.lit("false"), F.col("o_orderkey") % 13 - 3, F.col("o_custkey") % 8)
    return table(spark, sf_dir, "orders").select("o_orderkey", v.alias("v")).select("o_orderkey", "v.verdict", F.array_join("v.reasons", ",").alias("reasons"))


@query("SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of odd ids upserted into those of even ids by (user, type), the last one counts."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    base = versions.latest(e.where("event_id % 2 = 0"), ["user_id", "event_type"], ["event_id"])
    new = e.where("event_id % 2 = 1").withColumnRenamed("event_id", "eid").withColumn("event_id", F.col("eid"))
    both = versions.latest(base.unionByName(new.drop("eid")), ["user_id", "event_type"], ["event_id"])
    return versions.upsert(base, both, ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id", "value")


@query(
    """WITH RECURSIVE e AS (SELECT 'r' || n_regionkey AS a, 'n' || n_nationkey AS b FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders),
    w(node, depth) AS (SELECT 'r1', 0 UNION ALL SELECT b, depth + 1 FROM w JOIN e ON a = node) SELECT node, min(depth)::INT AS depth FROM w WHERE depth > 0 GROUP BY node"""
)
def dag_downstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that depends on one region, down to its customers' orders."""
    edge = lambda t, a, b, x, y: table(spark, sf_dir, t).select(F.concat(F.lit(x), F.col(a).cast("string")).alias("dependency"), F.concat(F.lit(y), F.col(b).cast("string")).alias("dependent"))
    edges = edge("nation", "n_regionkey", "n_nationkey", "r", "n").union(edge("customer", "c_nationkey", "c_custkey", "n", "c")).union(edge("orders", "o_custkey", "o_orderkey", "c", "o"))
    return versions.downstream(edges, spark.createDataFrame([("r1",)], "node string"))


EVIDENCE = "v AS (SELECT a.l_suppkey AS a, b.l_suppkey AS b, CASE WHEN a.l_returnflag = b.l_returnflag THEN 1 ELSE -1 END AS sign FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber - 1 WHERE a.l_suppkey <> b.l_suppkey)"


@query(f"WITH {EVIDENCE} SELECT least(a, b) AS a, greatest(a, b) AS b, count(*) FILTER (sign = 1) AS n_for, count(*) FILTER (sign = -1) AS n_against, sum(sign * 0.5)::DOUBLE AS strength FROM v GROUP BY ALL")
def pair_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence for and against pairs of suppliers that follow each other in an order, whichever comes first."""
    item = table(spark, sf_dir, "lineitem")
    left = item.select("l_orderkey", F.col("l_suppkey").alias("a"), F.col("l_returnflag").alias("fa"), (F.col("l_linenumber") + 1).alias("l_linenumber"))
    right = item.select("l_orderkey", F.col("l_suppkey").alias("b"), F.col("l_returnflag").alias("fb"), "l_linenumber")
    rows = left.join(right, ["l_orderkey", "l_linenumber"]).select("a", "b", F.lit("NEXT").alias("relation"), F.when(F.col("fa") == F.col("fb"), 1).otherwise(-1).alias("sign"), F.lit(0.5).alias("strength"), F.lit(False).alias("hard"))
    got = identity.pair_evidence(rows, [])
    n = lambda k: F.coalesce(F.try_element_at("counts", F.lit(k)), F.lit(0))
    return got.select("a", "b", n("NEXT:1").alias("n_for"), n("NEXT:-1").alias("n_against"), "strength")


@query("SELECT l_orderkey, l_linenumber, sha256(concat_ws('|', sha256(l_shipdate::VARCHAR), l_suppkey, CASE WHEN l_quantity = floor(l_quantity) THEN l_quantity::BIGINT || '.0' ELSE l_quantity::VARCHAR END, l_returnflag, 'v1'))[:32] AS cache_key FROM lineitem")
def render_cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested-hash keys of line items read as render units; the quantity stands for the speed."""
    rows = table(spark, sf_dir, "lineitem")
    key = render.cache_key(F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"), F.col("l_suppkey").cast("string"), F.col("l_quantity"), F.col("l_returnflag"), "v1")
    return rows.select("l_orderkey", "l_linenumber", key.alias("cache_key"))


@query("WITH s AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS seq, substr(o_orderpriority, 1, 1)::INT AS rank FROM orders), b AS (SELECT *, coalesce(rank > min(rank) OVER (PARTITION BY o_custkey ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS weak FROM s) SELECT o_custkey, o_orderkey, CASE WHEN weak THEN 'DISABLED' WHEN seq = max(seq) FILTER (NOT weak) OVER (PARTITION BY o_custkey) THEN 'ACTIVE' ELSE 'SUPERSEDED' END AS state FROM b")
def override_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer read as override rules in sequence, ranked by priority."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.left("o_orderpriority", F.lit(1)).cast("int").alias("rank"))
    rows = rows.withColumn("seq", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")))
    return versions.compile_overrides(rows, ["o_custkey"], "rank").select("o_custkey", "o_orderkey", "state")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 4 <> 0 UNION ALL SELECT c_custkey, 'new ' || c_name, c_acctbal FROM customer WHERE c_custkey % 4 = 0")
def insert_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers inserted where they are absent; those that are there stay as they were."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    return versions.insert_absent(c.where("c_custkey % 4 <> 0"), c.withColumn("c_name", F.concat(F.lit("new "), F.col("c_name"))), ["c_custkey"])


@query("WITH s AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS ordinal FROM orders) SELECT o_custkey, o_orderkey, ordinal::INT AS ordinal, (ordinal // 12)::BIGINT AS checkpoint_no FROM s WHERE ordinal >= o_custkey % 5")
def resume_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey").withColumn("ordinal", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")) - 1)
    done = rows.select("o_custkey").distinct().withColumn("next_ordinal", F.col("o_custkey") % 5)
    return versions.remaining(rows, done, ["o_custkey"]).select("o_custkey", "o_orderkey", "ordinal", F.col("checkpoint_no").cast("long").alias("checkpoint_no"))
