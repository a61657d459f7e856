"""Queries on documents, conversations and labels: fingerprints, leaks, evidence, context, splits, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.functions.text import hash_of, occurrences, truncated
from folio.operators import evaluation, integrity, names, sampling, segments
from folio.plans.base import query, table
from folio.sources import readers, sinks


@query("SELECT doc_id, substr(sha256(doc_id::VARCHAR || '|' || lang || '|' || coalesce(text, '')), 1, 32) AS fingerprint, substr(sha256(source || '|' || coalesce(text, '')), 1, 16) AS short_id FROM documents")
def doc_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", hash_of(F.col("doc_id"), F.col("lang"), F.col("text")).alias("fingerprint"), hash_of(F.col("source"), F.col("text"), size=16).alias("short_id"))


@query("SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY ALL HAVING count(*) > 1")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.exact_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(
    """WITH d AS (SELECT doc_id, source, min(doc_id) OVER (PARTITION BY sha256(text)) AS f FROM documents), u AS (SELECT *, CASE WHEN f < doc_id THEN f END AS duplicate_of FROM d)
    SELECT doc_id, duplicate_of, CASE WHEN duplicate_of IS NOT NULL THEN 'DUPLICATE' WHEN min(doc_id) FILTER (duplicate_of IS NULL) OVER (PARTITION BY source) < doc_id THEN 'NEW_REVISION' ELSE 'NEW' END AS outcome FROM u"""
)
def import_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.import_outcome(table(spark, sf_dir, "documents"), "doc_id", "source", "text").select("doc_id", "duplicate_of", "outcome")


@query(
    """WITH b AS (SELECT DISTINCT sha256(trim(regexp_replace(lower(unnest(string_split(text, chr(10)))), '\\s+', ' ', 'g'), ' ')) AS k FROM benchmark), l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
    SELECT doc_id, count(*) AS n_lines FROM l WHERE sha256(trim(regexp_replace(lower(line), '\\s+', ' ', 'g'), ' ')) NOT IN (SELECT k FROM b) GROUP BY doc_id"""
)
def leak_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines left in each document once those that equal a benchmark line are gone."""
    cut = lambda df, *keep: df.select(*keep, F.explode(F.split("text", "\n")).alias("text"))
    return sampling.leak_free(cut(table(spark, sf_dir, "documents"), "doc_id"), cut(table(spark, sf_dir, "benchmark"))).groupBy("doc_id").agg(F.count("*").alias("n_lines"))


SURFACES = "s AS (SELECT DISTINCT w AS surface FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM benchmark) WHERE length(w) BETWEEN 2 AND 6)"


def surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words of the lengths that a name may have."""
    words = F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1))).alias("surface")
    return table(spark, sf_dir, "benchmark").select(words).where(F.length("surface").between(2, 6)).distinct()


@query(
    f"""WITH {SURFACES}, g AS (SELECT text, unnest(range(1, length(text) + 1)) AS i FROM documents), p AS (SELECT CASE WHEN i > 1 THEN substr(text, i - 1, 1) ELSE '' END AS l, substr(text, i, 7) AS x FROM g),
    h AS (SELECT substr(x, 1, n) AS surface, l, substr(x, n + 1, 1) AS r FROM p, (VALUES (2), (3), (4), (5), (6)) AS v(n) WHERE length(x) >= n AND substr(x, 1, n) IN (SELECT surface FROM s))
    SELECT s.surface, count(h.r) AS total, count(*) FILTER (h.r IN (':', '?')) AS cue_bound, count(DISTINCT h.r) AS right_kinds, count(*) FILTER ((l = '' OR l IN (' ', chr(10), ',', '.')) AND NOT h.r IN (':', '?')) AS independent, count(h.r) - count(*) FILTER (h.r IN (':', '?')) AS free FROM s LEFT JOIN h USING (surface) GROUP BY s.surface"""
)
def surface_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus evidence of benchmark words of two to six letters: an n-gram equi-join over every place of every text."""
    return names.surface_evidence(table(spark, sf_dir, "documents"), surfaces(spark, sf_dir), cue_heads=":?", punct=" \n,.").select("surface", "total", "cue_bound", "right_kinds", "independent", "free")


@query(f"""WITH {SURFACES}, c AS (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations) SELECT conv_id, turn, surface, min(strpos(t, surface))::INT AS at FROM c, s WHERE contains(t, surface) GROUP BY ALL""")
def ngram_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    return names.mentions(rows, surfaces(spark, sf_dir), ["conv_id", "turn"]).select("conv_id", "turn", "surface", F.col("at").cast("int").alias("at"))


@query(f"""WITH {SURFACES}, c AS (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations) SELECT conv_id, turn, arg_min(surface, strpos(t, surface) * 100 - length(surface)) AS surface FROM c, s WHERE contains(t, surface) GROUP BY ALL""")
def leftmost_mention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.leftmost_longest(ngram_hits(spark, sf_dir), ["conv_id", "turn"])


@query("WITH b AS (SELECT text FROM benchmark), w AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[^\\s\\p{P}]+'))) AS token FROM b), t AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[^\\s\\p{P}]+'))) AS token FROM documents) SELECT token, count(DISTINCT doc_id) AS n_docs, count(*) AS n_places FROM t WHERE token IN (SELECT token FROM w) GROUP BY token")
def full_text_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings of the tokens of all benchmark items in an inverted index of all documents."""
    index = readers.inverted_index(table(spark, sf_dir, "documents"), "doc_id", "text")
    wanted = readers.inverted_index(table(spark, sf_dir, "benchmark"), "item_id", "text").select("token").distinct()
    return index.join(wanted, "token", "left_semi").groupBy("token").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_places"))


@query("WITH t AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[^\\s\\p{P}]+'))) AS token FROM documents) SELECT token, count(DISTINCT doc_id) AS n_docs, count(*) AS n_places FROM t GROUP BY token")
def full_text_index_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings of every token in an inverted index of all documents."""
    index = readers.inverted_index(table(spark, sf_dir, "documents"), "doc_id", "text")
    return index.groupBy("token").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_places"))


@query(
    """WITH w AS (SELECT DISTINCT item_id, lower(unnest(regexp_extract_all(text, '[^\\s\\p{P}]+'))) AS token FROM benchmark), k AS (SELECT item_id, count(*) AS k FROM w GROUP BY item_id),
    t AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[^\\s\\p{P}]+'))) AS token FROM documents), p AS (SELECT doc_id, token, count(*) AS n FROM t WHERE token IN (SELECT token FROM w) GROUP BY ALL)
    SELECT item_id, doc_id, sum(n)::BIGINT AS n_places FROM w JOIN p USING (token) JOIN k USING (item_id) GROUP BY item_id, doc_id, k HAVING count(*) = k"""
)
def full_text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold every token of a benchmark item, for all items."""
    index = readers.inverted_index(table(spark, sf_dir, "documents"), "doc_id", "text")
    wanted = readers.inverted_index(table(spark, sf_dir, "benchmark"), "item_id", "text").select("item_id", "token")
    return readers.match_queries(index, wanted, "item_id", "doc_id").select("item_id", "doc_id", F.col("n").alias("n_places"))


@query("SELECT conv_id, turn, (length(text) - length(replace(text, 'the', ''))) // 3 AS n_apart, CASE WHEN length(text) > 48 THEN substr(text, 1, 48) || '…' ELSE text END AS head FROM conversations")
def occurrence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", occurrences(F.col("text"), F.lit("the"), overlapping=False).cast("long").alias("n_apart"), truncated(F.col("text")).alias("head"))


@query("SELECT conv_id, turn, coalesce(array_to_string(array_agg(role || ':' || turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), ','), '') AS context FROM conversations")
def turn_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn("item", F.concat_ws(":", "role", F.col("turn").cast("string")))
    return segments.sliding_context(rows, ["conv_id"], ["turn"], "item", back=3).select("conv_id", "turn", F.array_join("context", ",").alias("context"))


@query(
    """WITH r AS (SELECT conv_id, turn, role, array_agg(role) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM conversations),
    d AS (SELECT *, list_reverse(coalesce(before, [])) AS rev FROM r), e AS (SELECT conv_id, turn, role, list_filter(rev, lambda x, i: list_position(rev, x) = i) AS recent FROM d)
    SELECT conv_id, turn, array_to_string(recent, ',') AS recent, coalesce(recent[2], recent[1]) AS by_turn FROM e"""
)
def turn_tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recent distinct speakers, latest first, and the speaker that alternation expects."""
    rows = segments.recent_distinct(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "role")
    return rows.select("conv_id", "turn", F.array_join("recent", ",").alias("recent"), segments.turn_speaker(F.col("recent")).alias("by_turn"))


@query("SELECT conv_id, turn, lag(CASE WHEN right(text, 1) = '.' THEN CASE role WHEN 'user' THEN '张三' ELSE '李四' END END) OVER (PARTITION BY conv_id ORDER BY turn) AS prev_cue FROM conversations")
def prev_cue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cue that ends the turn before: turns that end in a full stop get one, in ways that differ by turn, the others a shout."""
    w = W.partitionBy("conv_id").orderBy("turn")
    name = F.when(F.col("role") == "user", "张三").otherwise("李四")
    verb = F.element_at(F.array(*map(F.lit, ["说道：", "忙又说", "轻声问道”：", "叹了口气，忽然笑道："])), (F.col("turn") % 4 + 1).cast("int"))
    cue = F.when(F.col("turn") % 4 == 3, F.concat(F.lit("，忽然"), name, F.lit("笑道："))).otherwise(F.concat(F.lit("，"), name, verb))
    text = F.concat("text", F.when(F.right("text", F.lit(1)) == ".", cue).otherwise("，张三惨叫"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lag(segments.trailing_cue(text)).over(w).alias("prev_cue"))


@query("SELECT conv_id, role, min(turn) AS first, row_number() OVER (PARTITION BY conv_id ORDER BY min(turn), role)::INT AS rank FROM conversations GROUP BY conv_id, role")
def first_seen_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.first_seen_rank(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "role")


PREDICTED = "p AS (SELECT doc_id, lang, quality::VARCHAR AS gold, CASE WHEN n_chars % 11 = 0 THEN 'UNKNOWN' WHEN n_chars > 900 THEN '1' ELSE '0' END AS pred FROM labels JOIN documents USING (doc_id))"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plain length rule as predictions of the quality labels."""
    pred = F.when(F.col("n_chars") % 11 == 0, "UNKNOWN").when(F.col("n_chars") > 900, "1").otherwise("0")
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id").select("doc_id", "lang", F.col("quality").cast("string").alias("gold"), pred.alias("pred"))


@query(f"WITH {PREDICTED} SELECT gold, pred, count(*) AS n FROM p GROUP BY ALL")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.confusion(predictions(spark, sf_dir))


F1_SQL = f"""WITH {PREDICTED}, c AS (SELECT lang, gold, pred, count(*) AS n FROM p GROUP BY ALL), l AS (SELECT lang, gold AS label FROM c UNION SELECT lang, pred FROM c),
s AS (SELECT l.lang, label, coalesce(sum(n) FILTER (gold = label AND pred = label), 0) AS tp, coalesce(sum(n) FILTER (gold <> label AND pred = label), 0) AS fp, coalesce(sum(n) FILTER (gold = label AND pred <> label), 0) AS fn FROM l JOIN c USING (lang) GROUP BY ALL)"""


@query(f"{F1_SQL} SELECT lang, label, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round(CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6)::DOUBLE AS f1 FROM s")
def class_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.class_scores(evaluation.confusion(predictions(spark, sf_dir), ["lang"]), ["lang"]).withColumn("f1", F.round("f1", 6))


@query(f"{F1_SQL} SELECT lang, round(avg(CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END), 6) AS macro_f1, count(*) AS n_classes FROM s GROUP BY lang")
def macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.macro_f1(evaluation.confusion(predictions(spark, sf_dir), ["lang"]), ["lang"]).withColumn("macro_f1", F.round("macro_f1", 6))


@query(
    f"""WITH {PREDICTED}, r AS (SELECT lang, CASE gold WHEN '1' THEN 'SAME' ELSE 'DIFFERENT' END AS gold, CASE pred WHEN '1' THEN 'SAME' WHEN '0' THEN 'DIFFERENT' ELSE pred END AS pred, doc_id % 3 = 0 AS hard FROM p)
    SELECT lang, round(count(*) FILTER (gold = 'DIFFERENT' AND pred = 'SAME') / greatest(count(*) FILTER (gold = 'DIFFERENT'), 1), 6)::DOUBLE AS false_merge_rate, round(count(*) FILTER (gold = 'SAME' AND pred = 'DIFFERENT') / greatest(count(*) FILTER (gold = 'SAME'), 1), 6)::DOUBLE AS false_split_rate,
    5 * count(*) FILTER (gold = 'DIFFERENT' AND pred = 'SAME') + count(*) FILTER (gold = 'SAME' AND pred = 'DIFFERENT') AS weighted_identity_error, round(count(*) FILTER (hard AND pred = 'SAME') / greatest(count(*) FILTER (hard), 1), 6)::DOUBLE AS hard_negative_violation FROM r GROUP BY lang"""
)
def identity_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda c: F.when(F.col(c) == "1", "SAME").when(F.col(c) == "0", "DIFFERENT").otherwise(F.col(c))
    rows = predictions(spark, sf_dir).select("lang", name("gold").alias("gold"), name("pred").alias("pred"), (F.col("doc_id") % 3 == 0).alias("hard_block"))
    got = evaluation.identity_errors(rows, ["lang"])
    return got.select("lang", *(F.round(c, 6).alias(c) for c in ("false_merge_rate", "false_split_rate")), "weighted_identity_error", F.round("hard_negative_violation", 6).alias("hard_negative_violation"))


@query(f"WITH {PREDICTED} SELECT CASE WHEN gold = pred THEN 'CORRECT' WHEN pred = 'UNKNOWN' THEN 'ABSTAINED' ELSE 'WRONG_CANDIDATE' END AS error, count(*) AS n FROM p GROUP BY ALL")
def error_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.judged(predictions(spark, sf_dir).withColumn("candidates", F.array(F.lit("0"), F.lit("1"))))[0]


@query(f"WITH {PREDICTED} SELECT gold, pred, count(*) AS n FROM p WHERE gold <> pred GROUP BY ALL ORDER BY n DESC, gold, pred LIMIT 10")
def top_confusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most frequent confusions: a top-k report."""
    return evaluation.judged(predictions(spark, sf_dir).withColumn("candidates", F.array(F.lit("0"), F.lit("1"))))[1]


@query("SELECT coalesce(lang, 'ALL') AS lang, coalesce(quality::VARCHAR, 'ALL') AS quality, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY ROLLUP (lang, quality)")
def class_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return evaluation.two_level_counts(rows.select("lang", F.col("quality").cast("string").alias("quality")), "lang", "quality")


@query("WITH r AS (SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY md5('7:' || doc_id)) - 1) / count(*) OVER (PARTITION BY source) AS share FROM documents) SELECT doc_id, source, CASE WHEN share < 0.8 THEN 'train' ELSE 'dev' END AS split FROM r")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source")
    return sampling.stratified_split(rows, "source", sampling.md5_order(7, F.col("doc_id")), [("train", 0.8), ("dev", 0.2)])


@query("WITH g AS (SELECT source, row_number() OVER (ORDER BY md5('3:' || source)) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents)) SELECT doc_id, source, CASE WHEN k <= n - greatest(1, round_even(n * 0.15, 0)) - greatest(1, n - round_even(n * 0.7, 0) - greatest(1, round_even(n * 0.15, 0))) THEN 'train' WHEN k <= n - greatest(1, n - round_even(n * 0.7, 0) - greatest(1, round_even(n * 0.15, 0))) THEN 'dev' ELSE 'test' END AS split FROM documents JOIN g USING (source)")
def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole sources go to train, dev or test."""
    return sampling.group_split(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", sampling.md5_order(3, F.col("source")), 0.7, 0.15).select("doc_id", "source", "split")


@query("WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('5:' || doc_id)) AS turn FROM documents) SELECT doc_id, source, turn::INT AS turn FROM r ORDER BY turn, source LIMIT 50")
def round_robin_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty documents taken from the sources in turn: a sampling operator, so the limit is what it does."""
    return sampling.round_robin(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", sampling.md5_order(5, F.col("doc_id")), 50)


@query("WITH r AS (SELECT doc_id, CASE WHEN n_chars > 2000 THEN 2 WHEN n_chars > 800 THEN 1 ELSE 0 END AS score FROM documents) SELECT doc_id, score FROM r QUALIFY score >= 2 OR row_number() OVER (PARTITION BY score ORDER BY md5('9:' || doc_id)) <= 20")
def hard_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All long documents and twenty of each shorter class: a sampling operator."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") > 2000, 2).when(F.col("n_chars") > 800, 1).otherwise(0).alias("score"))
    return sampling.hard_pool(rows, "score", 2, 20, sampling.md5_order(9, F.col("doc_id")))


@query("WITH r AS (SELECT doc_id, CASE WHEN regexp_matches(text, '[#%&$]{3}') THEN 'SYMBOLS' WHEN regexp_matches(text, '!!') THEN 'SHOUTED' WHEN contains(text, ' | ') THEN 'TABLE' ELSE 'NONE' END AS bucket FROM documents) SELECT doc_id, bucket FROM r QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY md5('2:' || doc_id)) <= 25")
def bucket_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered cue buckets with an equal quota for each: a sampling operator."""
    kind = sampling.bucket_of(F.col("text"), [("SYMBOLS", "[#%&$]{3}"), ("SHOUTED", "!!"), ("TABLE", r" \| ")])
    rows = table(spark, sf_dir, "documents").select("doc_id", kind.alias("bucket"))
    return sampling.equal_quota(rows, "bucket", 100, 4, sampling.md5_order(2, F.col("doc_id")))


@query("SELECT split, count(*) AS n, sum(copy)::BIGINT AS copies FROM (SELECT CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS split, unnest(range(1, CASE WHEN quality = 1 THEN 2 ELSE 4 END)) AS copy FROM labels) GROUP BY split")
def training_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pools with their classes up-sampled: bad labels three times."""
    rows = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("bad").alias("split"))
    return sampling.mixture([(rows.where("split = 'good'"), 1), (rows.where("split = 'bad'"), 3)], 1, "doc_id").groupBy("split").agg(F.count("*").alias("n"), F.sum("copy").alias("copies"))


@query("WITH c AS (SELECT conv_id, list(role ORDER BY turn) AS r FROM conversations GROUP BY conv_id) SELECT conv_id, k::INT AS variant, array_to_string(list_concat(r[k + 1:], r[1:k]), ',') AS rotated FROM (SELECT conv_id, r, unnest(range(0, len(r))) AS k FROM c)")
def candidate_rotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("s"))
    return rows.select("conv_id", F.posexplode(sampling.rotations(F.col("s.role"))).alias("variant", "r")).select("conv_id", "variant", F.array_join("r", ",").alias("rotated"))


@query()
def seeded_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of each conversation in a seeded order; tested against a plain generator."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("s"))
    return rows.select("conv_id", F.array_join(sampling.lcg_permutation(F.transform("s", lambda x: x["turn"].cast("string")), F.col("conv_id")), ",").alias("permuted"))


@query("SELECT lang, count(*) AS n_rows, sum(('0x' || substr(sha256(doc_id::VARCHAR), 1, 12))::UBIGINT::HUGEINT)::VARCHAR AS digest FROM documents GROUP BY lang")
def dataset_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.manifest(table(spark, sf_dir, "documents"), "doc_id", ["lang"])


@query("SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'LEFT_ONLY' WHEN a.doc_id IS NULL THEN 'RIGHT_ONLY' WHEN a.lang IS DISTINCT FROM b.lang OR a.n_chars IS DISTINCT FROM b.n_chars THEN 'DIFFERENT' ELSE 'SAME' END AS status FROM (SELECT doc_id, lang, n_chars FROM documents WHERE doc_id % 5 <> 0) a FULL JOIN (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'xx' ELSE lang END AS lang, n_chars FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 5 = 0) b USING (doc_id)")
def record_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field by field comparison of two versions of the document table, each of which lacks some rows."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    old, new = d.where("doc_id % 5 <> 0"), d.where("doc_id % 3 <> 0 or doc_id % 5 = 0").withColumn("lang", F.when(F.col("doc_id") % 7 == 0, "xx").otherwise(F.col("lang")))
    return integrity.record_diff(old, new, ["doc_id"], ["lang", "n_chars"]).select("doc_id", "status")


@query("SELECT lang, round(avg(n), 6) AS rank_mean, (count(*) FILTER (n <= 3) / count(*))::DOUBLE AS recall_at_3 FROM (SELECT lang, doc_id % 9 + 1 AS n FROM documents) GROUP BY lang")
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("lang", (F.col("doc_id") % 9 + 1).alias("gold_rank"), F.lit(12).alias("size"))
    return evaluation.recall_at(rows, [3], ["lang"]).select("lang", F.round("rank_mean", 6).alias("rank_mean"), "recall_at_3")


@query("SELECT sum(length(text) - length(replace(text, ',', '')))::BIGINT AS commas, sum(len(regexp_extract_all(text, '!!')))::BIGINT AS shouts, sum(len(regexp_extract_all(text, '[#%&$]{3}')))::BIGINT AS symbols FROM documents")
def corpus_regex_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.regex_totals(table(spark, sf_dir, "documents"), {"commas": ",", "shouts": "!!", "symbols": "[#%&$]{3}"})
