"""Queries on made samples: a template grammar over the tables' names, contrasts, relabelled mentions, and candidate stores measured end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.operators import evaluation, generators, grammar, mentions
from folio.plans.base import query, table

TEMPLATES = [("journey", "{who} of {where} met {who:b} at {from}."), ("trade", "{where} trades with {where:b} by {from}."), ("place", "{where}.")]

POOLS = """pools AS (SELECT DISTINCT r_name AS domain, 'who' AS pool, c_name AS filler FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    UNION SELECT r_name, 'from', s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey UNION SELECT r_name, 'where', n_name FROM nation JOIN region ON n_regionkey = r_regionkey),
f AS (SELECT *, row_number() OVER (PARTITION BY domain, pool ORDER BY filler) - 1 AS k FROM pools),
z AS (SELECT domain, count(*) FILTER (pool = 'who') AS w, count(*) FILTER (pool = 'where') AS n, count(*) FILTER (pool = 'from') AS s FROM pools GROUP BY domain),
t AS (SELECT domain, w, n, s, 'journey' AS template_id, w * n * (w - 1) * s AS total FROM z UNION ALL SELECT domain, w, n, s, 'trade', n * (n - 1) * s FROM z UNION ALL SELECT domain, w, n, s, 'place', n FROM z),
q AS (SELECT r_name AS domain, count(*) AS quota, count(DISTINCT c_custkey) // 10 AS held FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name),
turns AS (SELECT t.*, quota, held, unnest(range(least(total, quota))) AS i FROM t JOIN q USING (domain)),
dealt AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY i, template_id) AS place FROM turns)"""


def drawn_sql(name: str, seed: int, quota: str = "quota") -> str:
    """The samples of one seed: templates take turns until the quota is met, and each number is taken apart digit by digit."""
    return f"""{name}_n AS (SELECT *, (('0x' || left(md5('{seed}:' || domain || ':' || template_id), 15))::BIGINT % total + i * CASE WHEN total % 1000003 <> 0 THEN 1000003 WHEN total % 999983 <> 0 THEN 999983 ELSE 998244353 END) % total AS number FROM dealt WHERE place <= {quota}),
{name}_d AS (SELECT *, CASE template_id WHEN 'journey' THEN [number % w, number // w % n, number // (w * n) % (w - 1), number // (w * n * (w - 1)) % s] WHEN 'trade' THEN [number % n, number // n % (n - 1), number // (n * (n - 1)) % s] ELSE [number] END AS d FROM {name}_n),
{name} AS (SELECT x.domain, template_id, number, CASE template_id WHEN 'journey' THEN a.filler || ' of ' || b.filler || ' met ' || c.filler || ' at ' || e.filler || '.' WHEN 'trade' THEN b.filler || ' trades with ' || c.filler || ' by ' || e.filler || '.' ELSE b.filler || '.' END AS text,
    CASE template_id WHEN 'journey' THEN 'X of ' || b.filler || ' met X at ' || e.filler || '.' WHEN 'trade' THEN b.filler || ' trades with ' || c.filler || ' by ' || e.filler || '.' ELSE b.filler || '.' END AS skeleton
  FROM {name}_d x LEFT JOIN f a ON a.domain = x.domain AND a.pool = 'who' AND template_id = 'journey' AND a.k = d[1]
  LEFT JOIN f b ON b.domain = x.domain AND b.pool = 'where' AND b.k = CASE template_id WHEN 'journey' THEN d[2] ELSE d[1] END
  LEFT JOIN f c ON c.domain = x.domain AND ((template_id = 'journey' AND c.pool = 'who' AND c.k = d[3] + (d[3] >= d[1])::BIGINT) OR (template_id = 'trade' AND c.pool = 'where' AND c.k = d[2] + (d[2] >= d[1])::BIGINT))
  LEFT JOIN f e ON e.domain = x.domain AND e.pool = 'from' AND e.k = CASE template_id WHEN 'journey' THEN d[4] ELSE d[3] END)"""


def samples(spark: SparkSession, sf_dir: str, seed: int, quota: str = "quota") -> DataFrame:
    """As many samples of each region as it has orders (or, ``held``, as a tenth of those who order), from the names of its customers, suppliers and nations."""
    read = lambda name: table(spark, sf_dir, name)
    places = read("nation").join(read("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", F.col("r_name").alias("domain"))
    customers = read("customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    suppliers = read("supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey"))
    pool = lambda rows, name, c: rows.select("domain", F.lit(name).alias("pool"), F.col(c).alias("filler"))
    fillers = pool(customers, "who", "c_name").unionByName(pool(suppliers, "from", "s_name")).unionByName(pool(places, "where", "n_name"))
    quotas = read("orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy("domain").agg(F.count("*").alias("quota"), F.expr("count(DISTINCT c_custkey) div 10").alias("held"))
    templates = quotas.select("domain", F.explode(F.array(*(F.struct(F.lit(i).alias("template_id"), F.lit(t).alias("template")) for i, t in TEMPLATES))).alias("t")).select("domain", "t.*")
    made = grammar.generate(templates, fillers, quotas.select("domain", F.col(quota).alias("quota")), seed)
    return made.withColumn("skeleton", grammar.skeleton(F.col("template"), F.col("fillers"), ["who"]))


@query(f"WITH {POOLS}, {drawn_sql('made', 7)} SELECT domain, template_id, number, text, skeleton FROM made")
def grammar_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of a template grammar by domain quotas; a template with few rows gives the rest of its share away."""
    return samples(spark, sf_dir, 7).select("domain", "template_id", "number", "text", "skeleton")


@query(
    f"""WITH {POOLS}, {drawn_sql('made', 7)}, {drawn_sql('held', 8, 'held')} SELECT domain, template_id, number, text FROM made m WHERE NOT EXISTS (FROM held h WHERE h.text = m.text) AND NOT EXISTS (FROM held h WHERE h.skeleton = m.skeleton)
    QUALIFY row_number() OVER (PARTITION BY text ORDER BY domain, template_id, number) = 1"""
)
def grammar_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples that stand in no held-out set (fewer of the same grammar, by another seed), neither word for word nor with other customers' names."""
    got = grammar.distinct_from(samples(spark, sf_dir, 7), samples(spark, sf_dir, 8, "held"), ["domain", "template_id", "number"])
    return got.select("domain", "template_id", "number", "text")


PATCHES = [("meeting", " met ", " never met ", "NONE"), ("trading", " trades with ", " avoids ", "NONE"), ("seaway", " by ", " without ", "OTHER")]


@query(
    f"""WITH {POOLS}, {drawn_sql('made', 7)}, l AS (SELECT *, CASE WHEN template_id = 'place' THEN 'NONE' ELSE 'EVENT' END AS old FROM made),
    p(patch, find, put, label) AS (VALUES {', '.join(str(p) for p in PATCHES)})
    SELECT domain, template_id, number, patch, replace(text, find, put) AS text, label, put AS evidence FROM l JOIN p ON len(string_split(text, find)) = 2 AND label <> old"""
)
def contrast_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sample with one phrase changed, so that its label is another."""
    labelled = samples(spark, sf_dir, 7).withColumn("label", F.when(F.col("template_id") == "place", "NONE").otherwise("EVENT"))
    return grammar.contrasts(labelled, PATCHES).select("domain", "template_id", "number", "patch", "text", "label", "evidence")


JUDGED = """j AS (SELECT role, conv_id * 1000 + turn AS asked, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Z][a-z]{1,14}') AS said, lag(regexp_extract_all(coalesce(text, ''), '[A-Z][a-z]{1,14}'), 1, []) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)"""


@query(
    f"""WITH {JUDGED} SELECT role, count(*) AS n, count(*) FILTER (t <> '') AS p1_parsed, count(*) FILTER (t <> '' AND length(t) % 10 > 0) AS p2_id, count(*) FILTER (t <> '' AND coalesce(said[1] IS NULL OR list_contains(before, said[1]), false)) AS p3_speaker,
    count(*) FILTER (t <> '' AND len(list_filter(said, lambda x: NOT list_contains(list_concat(before, said[1:3]), x))) = 0) AS p4_evidence, count(*) FILTER (t <> '' AND len(list_distinct(said)) = 1) AS p5_stable, count(*) FILTER (t <> '' AND len(said) = 0) AS p6_unknown FROM j GROUP BY role"""
)
def judge_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as answers, by role: the first name is the speaker, the names of the turn before are the candidates, all names the evidence and the repeats."""
    rows = turns(spark, sf_dir)
    before = F.coalesce(F.lag("said").over(W.partitionBy("conv_id").orderBy("turn")), F.array().cast("array<string>"))
    asked = F.col("conv_id") * 1000 + F.col("turn")
    answers = rows.select("role", (F.col("text") != "").alias("parsed"), asked.alias("asked"), F.when(F.length("text") % 10 > 0, asked).alias("answered"), F.coalesce(F.get("said", F.lit(0)), F.lit("UNKNOWN")).alias("speaker"), before.alias("candidates"), F.col("said").alias("evidence"), F.concat(before, F.slice("said", 1, 3)).alias("given"), F.col("said").alias("repeats"))
    return evaluation.judge_counters(answers, ["role"])


@query(
    r"""WITH c AS (SELECT role, len(regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+')) AS w, length(coalesce(text, '')) / 64 AS s, conv_id, turn FROM conversations), t AS (SELECT role, w, s, lag(w, 1, 0) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM c)
    SELECT role, count(*) AS n, round(sum(p) / sum(s), 1) AS prompt_tokens_s, round(sum(w) / sum(s), 1) AS generation_tokens_s, round(avg(p), 0) AS avg_input_tokens, round(avg(w), 0) AS avg_output_tokens FROM t GROUP BY role"""
)
def token_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words read (the turn before) and written by each role, where 64 characters take a second."""
    rows = turns(spark, sf_dir).withColumn("tokens_out", F.size(F.regexp_extract_all("text", F.lit(r"([^ \t-\r]+)"), F.lit(1)))).withColumn("seconds", F.length("text") / 64)
    return evaluation.token_rates(rows.withColumn("tokens_in", F.coalesce(F.lag("tokens_out").over(W.partitionBy("conv_id").orderBy("turn")), F.lit(0))), ["role"])


#: Words with a capital inside a sentence stand for names: Latin letters without accents.
NAME = "[A-Z][a-z]{1,14}"
TURNS = f"""c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{NAME}') AS said FROM conversations)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with the words that may be names, in order."""
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"), F.regexp_extract_all(text, F.lit(f"({NAME})"), F.lit(1)).alias("said"))


RELABELLED = f"""{TURNS}, m AS (SELECT *, CASE WHEN turn % 3 = 0 THEN [] ELSE said END AS given, list_distinct(regexp_extract_all(lag(text, 1, '') OVER (PARTITION BY conv_id ORDER BY turn), '[a-z]{{4,}}')) AS offered FROM c),
r AS (SELECT *, CASE WHEN len(given) = 0 THEN list_sort(list_filter(offered, lambda x: contains(text, x))) ELSE given END AS mentions FROM m)"""


def relabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third turn's mentions are missing; a second reading offers the long words of the turn before, of which those in the text count."""
    rows = turns(spark, sf_dir).withColumn("mentions", F.when(F.col("turn") % 3 == 0, F.array().cast("array<string>")).otherwise(F.col("said")))
    before = F.lag("text", 1, "").over(W.partitionBy("conv_id").orderBy("turn"))
    answers = rows.select("conv_id", "turn", F.array_sort(F.array_distinct(F.regexp_extract_all(before, F.lit("([a-z]{4,})"), F.lit(1)))).alias("mentions"))
    at = F.struct("conv_id", "turn")
    keyed = lambda df: df.withColumn("sample_id", at)
    return generators.relabel_empty(keyed(rows).withColumn("was_empty", F.size("mentions") == 0), keyed(answers).select("sample_id", "mentions"))


@query(f"WITH {RELABELLED} SELECT conv_id, turn, array_to_string(mentions, ',') AS mentions, instr(text, mentions[1]) - 1 AS first_start FROM r")
def relabelled_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions after a second reading of the texts that had none, with the first one's place."""
    return relabelled(spark, sf_dir).select("conv_id", "turn", F.array_join("mentions", ",").alias("mentions"), (F.instr("text", F.get("mentions", F.lit(0))) - 1).cast("long").alias("first_start"))


@query(f"WITH {RELABELLED} SELECT role, count(*) AS n, count(*) FILTER (len(given) = 0) AS none_before, count(*) FILTER (len(mentions) = 0) AS none_after FROM r GROUP BY role")
def relabelled_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many texts of each role have no mention before and after."""
    return generators.none_rates(relabelled(spark, sf_dir), ["role"])


STORES = f"""{TURNS}, w AS (SELECT conv_id, unnest(said) AS e, turn FROM c), e AS (SELECT conv_id, list(e) AS entities FROM (SELECT conv_id, e FROM w GROUP BY ALL HAVING count(DISTINCT turn) > 1) GROUP BY conv_id),
s AS (SELECT c.*, coalesce(entities, []) AS entities, lag(text, 1, '') OVER v AS before, lag(said, 1, []) OVER v AS active, lead(said) OVER v AS later FROM c LEFT JOIN e USING (conv_id) WINDOW v AS (PARTITION BY conv_id ORDER BY turn)),
g AS (SELECT *, list_filter(later, lambda x: list_contains(entities, x))[1] AS gold, regexp_extract_all(text, '({NAME}),', 1) AS cues,
    list_sort(list_distinct(list_filter(list_transform(list_filter(regexp_split_to_array(before, '[.,;:!? \\n]'), lambda b: trim(b) <> ''), lambda b: CASE WHEN regexp_full_match(b, '{NAME}') THEN CASE WHEN list_contains(entities, b) THEN b END WHEN length(b) > 4 THEN list_filter([left(b, 4), left(b, 3), left(b, 2)], lambda h: regexp_full_match(h, '{NAME}') AND list_contains(entities, h))[1] END), lambda b: b IS NOT NULL))) AS recent FROM s),
a AS (SELECT conv_id, turn, role, gold, list_concat(cues, list_filter(said, lambda m: list_contains(entities, m)), recent, active, list_filter(said, lambda m: NOT list_contains(entities, m))) AS l FROM g),
k AS (SELECT conv_id, turn, role, gold, list_filter(l, lambda x, i: list_position(l, x) = i) AS l FROM a), r AS (SELECT *, nullif(list_position(l, gold), 0) AS gold_rank, len(l) AS size FROM k WHERE gold IS NOT NULL)"""


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with their candidates of five sources and the gold: the first known name of the next turn. A conversation's names are the words with a capital of two of its turns or more."""
    rows = turns(spark, sf_dir)
    known = rows.select("conv_id", "turn", F.explode("said").alias("e")).groupBy("conv_id", "e").agg(F.count_distinct("turn").alias("n")).where("n > 1").groupBy("conv_id").agg(F.collect_list("e").alias("entities"))
    w = W.partitionBy("conv_id").orderBy("turn")
    none = F.array().cast("array<string>")
    rows = rows.withColumns({"before": F.lag("text", 1, "").over(w), "active": F.coalesce(F.lag("said").over(w), none), "later": F.lead("said").over(w)}).join(known, "conv_id", "left").withColumn("entities", F.coalesce("entities", none))
    entities = F.col("entities")
    recent = mentions.head_mentions(F.array("before"), entities, f"^{NAME}$", r"[.,;:!? \n]")
    cues = F.regexp_extract_all("text", F.lit(f"({NAME}),"), F.lit(1))
    store = mentions.candidate_store(cues, F.col("said"), recent, F.col("active"), entities)
    gold = F.get(F.filter("later", lambda x: F.array_contains(entities, x)), F.lit(0))
    return evaluation.gold_ranks(rows.select("conv_id", "turn", "role", store.alias("store"), gold.alias("gold")))


@query(f"WITH {STORES} SELECT conv_id, turn, gold, gold_rank::INT AS gold_rank, size::INT AS size FROM r")
def gold_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each gold among its turn's candidates."""
    return stores(spark, sf_dir).select("conv_id", "turn", "gold", "gold_rank", "size")


@query(
    f"""WITH {STORES}, p AS (SELECT role, size, row_number() OVER (PARTITION BY role ORDER BY size) - 1 AS i, count(*) OVER (PARTITION BY role) AS n FROM r)
    SELECT role, count(*) AS n, round(count(*) FILTER (gold_rank <= 1) / count(*), 6) AS recall_1, round(count(*) FILTER (gold_rank <= 4) / count(*), 6) AS recall_4, round(count(*) FILTER (gold_rank <= 12) / count(*), 6) AS recall_12, round(count(gold_rank) / count(*), 6) AS recall_all,
    (SELECT min(size) FROM p WHERE p.role = r.role AND i = n // 2)::INT AS size_p50, (SELECT min(size) FROM p WHERE p.role = r.role AND i = least(floor(0.95 * n), n - 1))::INT AS size_p95 FROM r GROUP BY role"""
)
def store_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of candidate stores at 1, 4, 12 and all, with exact percentiles of their size, by role."""
    return evaluation.store_report(stores(spark, sf_dir), [1, 4, 12], ["role"])

