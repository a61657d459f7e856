"""One query for each corpus operator, over whole tables, with production parameters; DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import byte_bpe, chat_format, decontaminate, license_scan, line_dedup, nearest, ngram_join, prefix_trie, quality_classifier, quality_rules, source_divergence, token_counts, url_filter
from folio.llm.common import table

#: Fixed values of the query on pages.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: Fixed values of the conversation that the query adds.
EXTRA_ID, EXTRA_TEXT = -7, "\\### Assistant: </turn> ok"


def bpe_files() -> tuple[str, str]:
    """The rank file and the pattern by which texts are split; this is the only place that names them."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def piece_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), piece_file())


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed (lines), n_runs, kept_sha256 (of the text that stays)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = line_dedup.dedup_lines(docs.withColumn("lines", F.size(line_dedup.lines_of(F.coalesce("text", F.lit("")))).cast("long")))
    removed = F.aggregate("removed_runs", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"] + 1)
    return done.select("doc_id", F.col("lines").alias("n_lines"), removed.alias("n_removed"), F.size("removed_runs").cast("long").alias("n_runs"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = quality_rules.apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    q = F.col("quality_rules")
    w = q["counts"]["w"]
    base = F.exists(q["failed"], lambda x: x.isin(*quality_rules.BASE_RULES))
    return done.select("doc_id", w["n_words"].alias("n_words"), w["word_chars"].alias("word_chars"), q["counts"]["c"]["n_symbols"].alias("n_symbols"), q["counts"]["l"]["n_dup_lines"].alias("n_dup_lines"), w["n_repeat_words"].alias("n_repeat_words"), base.alias("base_failed"), q["kept"].alias("kept"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(EXTRA_ID).cast("long").alias("conv_id"), F.col("id").cast("long").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(EXTRA_TEXT).alias("text"))
    made = chat_format.format_conversations(chat_format.linear_messages(turns.unionByName(extra)))
    read = made.select("tree", "formatted", chat_format.parse_turns(F.col("formatted")).alias("turns"), chat_format.masked_text(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return read.select(F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), digest(whole).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), digest(F.col("loss")).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "rule_host string, rule_path string, verdict string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.score(docs, model).select("doc_id", quality_classifier.held_out("doc_id").alias("held_out"), "score", "predicted")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(table(spark, sf_dir, "documents"), *bpe_files(), keep_ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.divergence(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


OPERATORS = [op1_token_counts, op2_line_dedup, op3_ngram_jaccard_join, op4_quality_rules, op5_chat_format, op6_url_filter, op7_quality_classifier, op8_byte_bpe, op9_decontaminate, op10_license_scan, op11_nearest_neighbours, op12_source_divergence, op13_prefix_trie]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(quality_rules.STOP_WORDS))
    limits = {name: limit for name, _, _, limit in quality_rules.RULES}
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    return {
        "op4_quality_rules": f"""
            WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
            w AS (SELECT r, doc_id, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM d),
            g AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
            k AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS c FROM g),
            rep AS (SELECT r, count(DISTINCT i + o) AS n FROM k, (VALUES (0), (1), (2)) AS v(o) WHERE c >= 2 GROUP BY r),
            lines AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
            f AS (
                SELECT w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
                    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
                    len(list_filter(w, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') IN ({stop}))) AS n_stop,
                    length(regexp_replace(t, '[^\\p{{Lu}}]+', '', 'g')) AS n_upper, length(regexp_replace(t, '[^\\p{{L}}]+', '', 'g')) AS n_letters, len(l) AS n_lines,
                    len(list_filter(l, lambda x: regexp_matches(x, '^\\s*[-*•·]'))) AS n_bullet, len(list_filter(l, lambda x: regexp_matches(x, '(\\.\\.\\.|…)\\s*$'))) AS n_cut
                FROM w JOIN lines USING (r) LEFT JOIN rep USING (r))
            SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
                NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR word_chars < {limits["short_words"]} * n_words OR word_chars > {limits["long_words"]} * n_words
                    OR n_symbols > {limits["symbols"]} * n_words OR n_stop < {limits["few_stop_words"]} * n_words OR n_upper > {limits["upper_case"]} * n_letters
                    OR n_dup_lines > {limits["repeated_lines"]} * n_lines OR n_bullet > {limits["bullet_lines"]} * n_lines OR n_cut > {limits["cut_lines"]} * n_lines) AS kept
            FROM f""",
        "op5_chat_format": f"""
            WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
                UNION ALL SELECT {EXTRA_ID}, turn, role, '{EXTRA_TEXT}' FROM (VALUES (0, 'user'), (1, 'assistant')) AS x(turn, role)),
            e AS (SELECT *, replace(replace(replace(text, '\\', '\\\\'), '<turn:', '<\\turn:'), '</turn>', '<\\/turn>') AS body, replace(replace(role, '%', '%25'), '>', '%3E') AS head FROM c)
            SELECT conv_id::BIGINT AS conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
                coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
                sum(length(head) + length(body) + 15)::BIGINT AS formatted_chars
            FROM e GROUP BY conv_id""",
        "op6_url_filter": f"""
            WITH p AS (SELECT page_id, row_number() OVER () AS r, coalesce(url, '') AS u FROM pages),
            q AS (SELECT page_id, r, translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM p),
            m AS (SELECT r, x.host || x.path AS rule, x.verdict, row_number() OVER (PARTITION BY r ORDER BY length(x.host) + length(x.path) DESC, length(x.host) DESC, x.verdict DESC) AS k
                FROM q, (VALUES {rules}) AS x(host, path, verdict) WHERE (q.host = x.host OR ends_with(q.host, '.' || x.host)) AND starts_with(q.path, x.path))
            SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM q LEFT JOIN (SELECT * FROM m WHERE k = 1) USING (r)""",
        "op12_source_divergence": """
            WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
            w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
            n AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL),
            k AS (SELECT lang, term, count(*) AS total FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 30),
            g AS (SELECT DISTINCT lang, source FROM d),
            v AS (SELECT lang, count(*) AS v, sum(total) AS n FROM k GROUP BY lang),
            c AS (SELECT lang, source, term, coalesce(n.n, 0) AS n, total, sum(coalesce(n.n, 0)) OVER (PARTITION BY lang, source) AS own FROM g JOIN k USING (lang) LEFT JOIN n USING (lang, source, term)),
            p AS (SELECT c.lang, source, term, c.n, 1 + (1000000000::HUGEINT * (c.n + 5)) // (own + 5 * v) AS p, 1 + (1000000000::HUGEINT * (total + 5)) // (v.n + 5 * v) AS q FROM c JOIN v ON v.lang = c.lang),
            s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
            o AS (
                SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g JOIN g AS h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN s ON s.lang = g.lang AND s.source = g.source AND s.item = h.source
                UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q),
            r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM o)
            SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 50""",
    }
