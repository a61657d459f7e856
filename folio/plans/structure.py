"""Queries on text structure: lines, layout, blocks, boundaries, paragraphs, chapters, segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.checkpoints import cut
from folio.functions.numerals import parse_numeral
from folio.lexicon import LATIN
from folio.operators import asof, blocks, boundaries, chapters, layout, lines, paragraphs, segments
from folio.plans.base import CLASS, LINES, RUN_KIND, query, table

#: Rules for Latin prose, as a rule pack's rows: (id, enable, name, rule, example, serialNumber).
LATIN_RULES = [(-12, True, "english", r"^(?i)(?:chapter|section|part|episode)\s{0,4}\d{1,6}", "", 0), (-8, True, "prefix", r"^\d{1,6}[. ]", "", 1), (-25, True, "capitals", r"^[A-Z][^.!?]{0,28}[.!?]$", "", 2), (-3, True, "short", r"^\S{1,24}$", "", 3), (-5, False, "number", r"^\d+$", "", 4)]


def document_lines(spark: SparkSession, sf_dir: str, spans: bool = False) -> DataFrame:
    return lines.physical_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), spans=spans)


@query(
    f"""WITH {LINES} SELECT doc_id, line_no, char_count, (coalesce(sum(length(text)) OVER w, 0))::BIGINT AS char_start, (coalesce(sum(strlen(text) + 1) OVER w, 0))::BIGINT AS byte_start, is_blank, sha256(text) AS line_sha
    FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
)
def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = document_lines(spark, sf_dir, spans=True)
    return rows.select("doc_id", "line_no", "char_count", F.col("char_start").cast("long").alias("char_start"), F.col("byte_start").cast("long").alias("byte_start"), "is_blank", F.sha2("text", 256).alias("line_sha"))


@query(f"""WITH {LINES} SELECT doc_id, line_no, strlen(text) AS n_bytes, sha256(text) AS line_sha FROM lines""")
def lazy_line_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line, cut out of its document by byte offsets, with its length in bytes."""
    offsets = lines.lines_without_text(document_lines(spark, sf_dir, spans=True))
    rows = lines.read_lines(offsets.select("doc_id", "line_no", "byte_start", "byte_end"), table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "line_no", (F.col("byte_end") - F.col("byte_start")).cast("long").alias("n_bytes"), F.sha2("text", 256).alias("line_sha"))


@query(f"""WITH {LINES} SELECT doc_id, line_no, sha256(text) AS line_sha FROM lines""")
def lazy_line_read_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line, cut out of its document by byte offsets."""
    offsets = lines.lines_without_text(document_lines(spark, sf_dir, spans=True))
    return lines.read_lines(offsets.select("doc_id", "line_no", "byte_start", "byte_end"), table(spark, sf_dir, "documents")).select("doc_id", "line_no", F.sha2("text", 256).alias("line_sha"))


@query(
    f"""WITH {LINES}, s AS (SELECT *, coalesce(sum(char_count) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS char_start FROM lines),
    a AS (SELECT doc_id, (n_chars * k // 4)::BIGINT AS at_offset FROM documents, (VALUES (0), (1), (2), (3)) AS v(k))
    SELECT a.doc_id, a.at_offset, max(s.line_no)::INT AS line_no FROM a LEFT JOIN s ON s.doc_id = a.doc_id AND s.char_start <= a.at_offset AND a.at_offset < s.char_start + s.char_count GROUP BY a.doc_id, a.at_offset"""
)
def line_at_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.transform(F.array(*map(F.lit, range(4))), lambda k: F.floor(F.col("n_chars") * k / 4).cast("long"))).alias("at_offset")).distinct()
    return lines.line_at(docs, document_lines(spark, sf_dir, spans=True), at="at_offset").select("doc_id", "at_offset", "line_no")


@query(f"WITH {LINES}, c AS (SELECT *, trim(text, ' ') AS t FROM lines) SELECT doc_id, line_no, {CLASS} AS block_type, ({CLASS}) IN ('UNKNOWN', 'SEPARATOR', 'BOILERPLATE') AS skip_read FROM c")
def line_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.classified_lines(document_lines(spark, sf_dir)).select("doc_id", "line_no", "block_type", "skip_read")


PROFILE_SQL = f"""WITH {LINES}, b AS (SELECT *, char_count // 5 * 5 AS bucket FROM lines), m AS (SELECT doc_id, bucket AS mode_len FROM (SELECT doc_id, bucket, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, bucket) AS k FROM b WHERE NOT is_blank GROUP BY doc_id, bucket) WHERE k = 1),
p AS (SELECT doc_id, count(*) FILTER (NOT is_blank) AS n, median(char_count) FILTER (NOT is_blank) AS median_len, avg(char_count) FILTER (NOT is_blank) AS mean_len, stddev_pop(char_count) FILTER (NOT is_blank) AS std_len, max(mode_len) AS mode_len, count(*) FILTER (NOT is_blank AND abs(char_count - mode_len) <= 2) / n AS near_mode,
    count(*) FILTER (is_blank) / count(*) AS blank_ratio, 0.0 AS full_indent, count(*) FILTER (NOT is_blank AND starts_with(text, ' ')) / n AS space_indent, count(*) FILTER (NOT is_blank AND right(text, 1) IN ('.', '!', '?', '…')) / n AS terminal, count(*) FILTER (NOT is_blank AND contains(text, ':')) / n AS colon_any,
    count(*) FILTER (NOT is_blank AND regexp_matches(trim(text, ' '), '^[*\\-—＝=~☆★●○◆◇▁▂▃▄]{{3,}}\\s*$')) / n AS separator, count(*) FILTER (NOT is_blank AND char_count <= 6) / n AS very_short, count(*) FILTER (NOT is_blank AND char_count > 1024) / n AS very_long, count(DISTINCT char_count) FILTER (NOT is_blank) AS distinct_len
    FROM b JOIN m USING (doc_id) GROUP BY doc_id),
c AS (SELECT *, CASE WHEN separator > 0.05 THEN 'MIXED' WHEN very_short > 0.5 AND terminal < 0.3 AND median_len < 24 AND std_len < 8 THEN 'POETRY_LIKE' WHEN colon_any > 0.5 AND median_len < 30 THEN 'SCRIPT_DIALOGUE' WHEN near_mode >= 0.45 AND mode_len >= 8 AND terminal < 0.55 AND full_indent < 0.1 AND space_indent < 0.1 THEN 'FIXED_WIDTH_HARD_WRAP'
    WHEN blank_ratio >= 0.15 THEN 'BLANK_LINE_PARAGRAPH' WHEN full_indent BETWEEN 0.3 AND 0.95 AND terminal > 0.5 THEN 'INDENTED_PARAGRAPH' WHEN terminal > 0.6 AND blank_ratio < 0.12 AND (std_len > 2 OR distinct_len > 3) THEN 'PARAGRAPH_PER_LINE' WHEN very_long > 0.1 THEN 'UNKNOWN' ELSE 'MIXED' END AS profile_type FROM p)"""


@query(
    f"""{PROFILE_SQL} SELECT doc_id, n::BIGINT AS n, median_len::DOUBLE AS median_len, round(mean_len, 6) AS mean_len, round(std_len, 5) AS std_len, mode_len::BIGINT AS mode_len, round(near_mode, 6) AS near_mode, round(terminal, 6) AS terminal, round(very_short, 6) AS very_short, distinct_len::BIGINT AS distinct_len, profile_type,
    round(CASE profile_type WHEN 'FIXED_WIDTH_HARD_WRAP' THEN greatest(0.5, least(1.0, near_mode * 0.6 + (1 - terminal) * 0.4)) WHEN 'BLANK_LINE_PARAGRAPH' THEN blank_ratio * 0.8 + 0.2 WHEN 'INDENTED_PARAGRAPH' THEN full_indent * 0.5 + terminal * 0.3 + 0.2 WHEN 'PARAGRAPH_PER_LINE' THEN terminal * 0.6 + 0.3 WHEN 'POETRY_LIKE' THEN 0.8 WHEN 'SCRIPT_DIALOGUE' THEN 0.8 ELSE 0.5 END, 6)::DOUBLE AS confidence FROM c"""
)
def layout_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout figures, class and confidence of each document: the flagship plan."""
    r = lambda c, n=6: F.round(c, n).alias(c)
    out = layout.classified(layout.profile(document_lines(spark, sf_dir), ["doc_id"]))
    return out.select("doc_id", "n", "median_len", r("mean_len"), r("std_len", 5), F.col("mode_len").cast("long").alias("mode_len"), r("near_mode"), r("terminal"), r("very_short"), "distinct_len", "profile_type", r("confidence"))


@query(f"WITH {LINES} SELECT doc_id, (char_count // 5 * 5)::INT AS bucket, count(*) AS n_lines FROM lines WHERE NOT is_blank GROUP BY ALL")
def layout_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.histogram(document_lines(spark, sf_dir), ["doc_id"])


@query(f"WITH {LINES}, h AS (SELECT doc_id, (char_count // 5 * 5)::INT AS bucket, count(*) AS n_lines FROM lines WHERE NOT is_blank GROUP BY ALL) SELECT doc_id, bucket, n_lines, row_number() OVER (PARTITION BY doc_id ORDER BY n_lines DESC, bucket)::INT AS rank FROM h QUALIFY rank <= 3")
def layout_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.top_modes(layout.histogram(document_lines(spark, sf_dir), ["doc_id"]), ["doc_id"])


@query()
def layout_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of five lines that differ from their document's layout; a region's start sticks. No SQL is registered."""
    rows = document_lines(spark, sf_dir).withColumn("start_line", F.lit(1))
    return layout.layout_regions(rows, window=5)


#: Turns written as lines: two of a script, one of a message log and one of a list, in turn, and a few of prose.
TURN_LINES = r"""lines AS (SELECT conv_id AS doc_id, turn::INT AS line_no, CASE WHEN turn % 11 = 10 THEN 'Prose. More of it, and on; so it goes' WHEN turn % 4 < 2 THEN role || ': ' || c WHEN turn % 4 = 2 THEN role || ' 12:30' ELSE (turn % 100) || '. ' || c END AS text, turn % 13 = 12 AS is_blank
FROM (SELECT *, left(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g'), 20) || 'x' AS c FROM conversations))"""


def turn_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn, c = F.col("turn"), F.concat(F.left(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", ""), F.lit(20)), F.lit("x"))
    text = F.when(turn % 11 == 10, "Prose. More of it, and on; so it goes").when(turn % 4 < 2, F.concat("role", F.lit(": "), c)).when(turn % 4 == 2, F.concat("role", F.lit(" 12:30"))).otherwise(F.concat((turn % 100).cast("string"), F.lit(". "), c))
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), turn.cast("int").alias("line_no"), text.alias("text"), (turn % 13 == 12).alias("is_blank"))


@query(
    f"""WITH {TURN_LINES}, k AS (SELECT doc_id, line_no, {RUN_KIND} AS kind FROM (SELECT *, trim(text, ' ') AS t FROM lines WHERE NOT is_blank)), i AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - row_number() OVER (PARTITION BY doc_id, kind ORDER BY line_no) AS g FROM k)
    SELECT doc_id, kind, min(line_no) AS from_line, max(line_no) AS to_line, count(*) AS n_lines FROM i WHERE kind IS NOT NULL GROUP BY doc_id, kind, g HAVING count(*) >= CASE WHEN kind = 'MESSAGE_LOG' THEN 1 ELSE 2 END"""
)
def script_message_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of script, message and list lines among turns written as such lines."""
    return blocks.block_runs(turn_lines(spark, sf_dir)).select("doc_id", "kind", "from_line", "to_line", "n_lines")


@query()
def poetry_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs measured from their own first line; a lexicon without end marks, since all lines of these tables end with one."""
    from dataclasses import replace

    return blocks.poetry_runs(document_lines(spark, sf_dir), lex=replace(LATIN, terminal="!?…"), high=40)


def boundary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = document_lines(spark, sf_dir, spans=True)
    depth = boundaries.quote_depths(rows)
    prof = layout.classified(layout.profile(rows, ["doc_id"])).select("doc_id", "mode_len", "profile_type", "full_indent")
    special = blocks.line_class(F.col("text")).isin("SEPARATOR", "BOILERPLATE", "LYRICS", "SCREEN_TEXT", "LETTER")
    runs = blocks.block_runs(rows).select("doc_id", F.explode(F.sequence("from_line", "to_line")).alias("line_no"), F.lit(True).alias("__run"))
    marked = rows.join(depth, ["doc_id", "line_no"]).join(runs, ["doc_id", "line_no"], "left").join(prof, "doc_id").withColumn("in_group", F.coalesce("__run", F.lit(False)) | special)
    feats = boundaries.boundary_features(marked)
    return boundaries.decide(feats.join(prof.select("doc_id", "profile_type", "full_indent"), "doc_id"))


#: Boundaries in SQL. The tables have no quotation marks and no ideographic indents, so those features are left out.
BOUNDARY_SQL = f"""{PROFILE_SQL}, k AS (SELECT doc_id, line_no, text, char_count, {RUN_KIND} AS kind, ({CLASS}) IN ('SEPARATOR', 'BOILERPLATE', 'LYRICS', 'SCREEN_TEXT', 'LETTER') AS special FROM (SELECT *, trim(text, ' ') AS t FROM lines WHERE NOT is_blank)),
i AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - row_number() OVER (PARTITION BY doc_id, kind ORDER BY line_no) AS g FROM k),
j AS (SELECT *, special OR (kind IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, kind, g) >= CASE WHEN kind = 'MESSAGE_LOG' THEN 1 ELSE 2 END) AS grp FROM i),
f AS (SELECT j.doc_id, line_no, lead(line_no) OVER w AS next_line, text, char_count, grp, lead(grp) OVER w AS next_grp, c.mode_len, c.profile_type FROM j JOIN c USING (doc_id) WINDOW w AS (PARTITION BY j.doc_id ORDER BY line_no)),
s AS (SELECT *, next_line > line_no + 1 AS gap, right(text, 1) IN ('.', '!', '?', '…', '"', '»') AS term, CASE WHEN profile_type = 'FIXED_WIDTH_HARD_WRAP' THEN 2.0 ELSE 0 END + CASE WHEN mode_len > 0 AND abs(char_count - mode_len) <= 2 THEN 1.2 ELSE 0 END + CASE WHEN NOT right(text, 1) IN ('.', '!', '?', '…', '"', '»', ':') THEN 1.4 ELSE 0 END
    + CASE WHEN right(text, 1) = ',' THEN 1.0 ELSE 0 END + CASE WHEN right(text, 1) = ';' THEN 0.5 ELSE 0 END - CASE WHEN right(text, 1) IN ('.', '!', '?', '…', '"', '»') THEN 1.0 ELSE 0 END AS score FROM f WHERE next_line IS NOT NULL),
bd AS (SELECT doc_id, line_no, next_line, score, CASE WHEN next_grp OR grp THEN 'AUTHOR_LINE_BREAK' WHEN gap THEN 'HARD_PARAGRAPH' WHEN score >= 0.5 THEN 'SOFT_WRAP' WHEN score <= -0.5 THEN 'HARD_PARAGRAPH' ELSE 'UNCERTAIN' END AS boundary_type,
    CASE WHEN next_grp OR grp THEN 0.92 WHEN gap THEN CASE WHEN profile_type = 'BLANK_LINE_PARAGRAPH' THEN 0.97 ELSE 0.85 END WHEN abs(score) >= 3 THEN 0.99 WHEN abs(score) >= 2 THEN 0.92 WHEN abs(score) >= 1 THEN 0.82 ELSE 0.6 END AS boundary_confidence FROM s)"""


@query(f"{BOUNDARY_SQL} SELECT doc_id, line_no, next_line, round(score, 6)::DOUBLE AS score, boundary_type, boundary_confidence::DOUBLE AS boundary_confidence FROM bd")
def line_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boundary_rows(spark, sf_dir).select("doc_id", "line_no", "next_line", "score", "boundary_type", "boundary_confidence")


SESSION_SQL = f"""{BOUNDARY_SQL}, q AS (SELECT l.doc_id, l.line_no, l.text, sum(CASE WHEN bd.boundary_type <> 'SOFT_WRAP' THEN 1 ELSE 0 END) OVER (PARTITION BY l.doc_id ORDER BY l.line_no) AS seg FROM lines l LEFT JOIN bd ON bd.doc_id = l.doc_id AND bd.next_line = l.line_no WHERE NOT l.is_blank)"""


@query(f"{SESSION_SQL} SELECT doc_id, line_no, seg::BIGINT AS seg FROM q")
def paragraph_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.sessions(document_lines(spark, sf_dir, spans=True), boundary_rows(spark, sf_dir)).select("doc_id", "line_no", F.col("seg").cast("long").alias("seg"))


PARAGRAPH_SQL = f"""{SESSION_SQL}, e AS (SELECT *, lag(text) OVER (PARTITION BY doc_id, seg ORDER BY line_no) AS before, {CLASS} AS kind FROM (SELECT *, trim(text, ' ') AS t FROM q)),
o AS (SELECT *, CASE WHEN before IS NULL OR regexp_matches(before, '[ \\t]$') THEN '' WHEN regexp_matches(before, '[A-Za-z0-9]$') AND regexp_matches(text, '^[A-Za-z0-9]') THEN ' ' ELSE '' END || text AS part FROM e),
pp AS (SELECT doc_id, seg, min(line_no) AS from_line, max(line_no) AS to_line, string_agg(part, '' ORDER BY line_no) AS text, coalesce(first(kind ORDER BY line_no) FILTER (kind NOT IN ('PROSE', 'UNKNOWN')), 'PROSE') AS block_type FROM o GROUP BY doc_id, seg),
pr AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seg) - 1 AS paragraph_index FROM pp WHERE block_type NOT IN ('SEPARATOR', 'BOILERPLATE'))"""


def built_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.build_paragraphs(paragraphs.sessions(document_lines(spark, sf_dir, spans=True), boundary_rows(spark, sf_dir)))


@query(f"{PARAGRAPH_SQL} SELECT doc_id, paragraph_index::INT AS paragraph_index, from_line, to_line, block_type, length(text)::INT AS n_chars, sha256(text) AS text_sha FROM pr")
def paragraph_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built_paragraphs(spark, sf_dir).select("doc_id", "paragraph_index", "from_line", "to_line", "block_type", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("text_sha"))


@query(
    f"""{PARAGRAPH_SQL}, x AS (SELECT doc_id, paragraph_index, trim(text, ' ') AS p, lead(trim(text, ' ')) OVER (PARTITION BY doc_id ORDER BY paragraph_index) AS n FROM pr)
    SELECT doc_id, paragraph_index::INT AS paragraph_index, (paragraph_index + 1)::INT AS next_index, CASE WHEN length(replace(p, '»', '')) - length(replace(p, '«', '')) > 0 OR length(replace(n, '«', '')) - length(replace(n, '»', '')) > 0 THEN 'QUOTE_CONTINUATION' ELSE 'CONTINUATION' END AS link_type FROM x WHERE n IS NOT NULL"""
)
def paragraph_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.paragraph_links(built_paragraphs(spark, sf_dir)).select("doc_id", "paragraph_index", "next_index", "link_type")


@query(f"{PARAGRAPH_SQL} SELECT doc_id, paragraph_index::INT AS paragraph_index, length(text)::INT AS n_chars FROM pr WHERE length(trim(text, ' ')) BETWEEN 40 AND 600 AND NOT regexp_matches(trim(text, ' '), '^(第.{{1,9}}[章节回卷]|Chapter\\s+\\d+)')")
def usable_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built_paragraphs(spark, sf_dir).where(paragraphs.paragraph_filter(F.col("text"))).select("doc_id", "paragraph_index", F.length("text").alias("n_chars"))


@query(
    r"""WITH h AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '<[^>]+>', chr(10), 'g') AS t FROM pages),
    l AS (SELECT page_id, unnest(list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')) AS line FROM h)
    SELECT page_id, count(*) AS n_lines, sum(length(line))::BIGINT AS n_chars, count(*) FILTER (regexp_matches(line, '^https?://\S+$|^www\..+\.[a-z]{2,}$')) AS n_boilerplate FROM l GROUP BY page_id"""
)
def html_page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text lines of web pages: markup becomes line breaks, then lines are counted and classed."""
    bare = F.regexp_replace(F.regexp_replace("html", r"(?s)<(script|style)[^>]*>.*?</(script|style)>", ""), r"<[^>]+>", "\n")
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(F.filter(F.transform(F.split(bare, "\n"), lambda x: F.trim(x)), lambda x: x != "")).alias("line"))
    return rows.groupBy("page_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"), F.count_if(blocks.line_class(F.col("line")) == "BOILERPLATE").alias("n_boilerplate"))


def rules_frame(spark: SparkSession) -> DataFrame:
    return chapters.typed_rules(spark.createDataFrame(LATIN_RULES, "id int, enable boolean, name string, rule string, example string, serialNumber int"))


def candidate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chapters.match_rules(document_lines(spark, sf_dir), rules_frame(spark))


RULE_SQL = ", ".join(f"({i}, '{r}', {p})" for i, on, _, r, _, p in LATIN_RULES if on)
CANDIDATE_SQL = f"""WITH {LINES}, rules(rule_no, regex, priority) AS (VALUES {RULE_SQL}),
cand AS (SELECT doc_id, line_no, rule_no, text, char_count, CASE rule_no WHEN -12 THEN 'ENGLISH_CHAPTER' WHEN -8 THEN 'ARABIC_PREFIX' WHEN -3 THEN 'SPECIAL_TITLE' ELSE 'CUSTOM' END AS family, CASE rule_no WHEN -25 THEN 0.4 ELSE 0.7 END AS regex_score, (100 - priority) / 100 AS priority_score,
    CASE WHEN char_count <= 30 THEN 1.0 WHEN char_count <= 60 THEN 0.7 WHEN char_count <= 100 THEN 0.4 ELSE 0.15 END AS length_score, CASE rule_no WHEN -12 THEN regexp_extract(text, '(?i)(?:chapter|section|part|episode)\\s{{0,4}}(\\d{{1,6}})', 1)
    WHEN -8 THEN coalesce(nullif(regexp_extract(text, '^(\\d{{1,6}})[、. 　]', 1), ''), nullif(regexp_extract(text, '(\\d{{1,6}})\\s*[）)]\\s*$', 1), ''), regexp_extract(text, '^(\\d{{1,6}})$', 1)) ELSE regexp_extract(text, '(\\d{{1,6}})', 1) END AS serial_raw
    FROM lines, rules WHERE NOT is_blank AND (char_count <= 1024 OR rule_no IN (-8, -12)) AND regexp_matches(text, regex)),
win AS (SELECT *, try_cast(nullif(serial_raw, '') AS INT) AS serial FROM cand QUALIFY row_number() OVER (PARTITION BY doc_id, line_no ORDER BY CASE family WHEN 'ENGLISH_CHAPTER' THEN 4 WHEN 'SPECIAL_TITLE' THEN 4 WHEN 'ARABIC_PREFIX' THEN 3 ELSE 2 END DESC, priority_score, CASE WHEN try_cast(nullif(serial_raw, '') AS INT) IS NULL THEN 1 ELSE 0 END, regex_score DESC, rule_no DESC) = 1)"""


@query(f"{CANDIDATE_SQL} SELECT doc_id, line_no, 'rule-' || rule_no AS rule_id, family, regex_score::DOUBLE AS regex_score, length_score::DOUBLE AS length_score FROM cand")
def chapter_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidate_rows(spark, sf_dir).select("doc_id", "line_no", "rule_id", "family", "regex_score", "length_score")


@query(f"{CANDIDATE_SQL} SELECT doc_id, line_no, 'rule-' || rule_no AS rule_id, serial FROM win")
def line_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chapters.winners(candidate_rows(spark, sf_dir)).select("doc_id", "line_no", "rule_id", "serial")


@query(f"{CANDIDATE_SQL}, h AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS k FROM win) SELECT doc_id, family, count(*) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(k)) = 1 AS dominant FROM h WHERE k <= 30 GROUP BY doc_id, family")
def style_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chapters.style_profile(chapters.winners(candidate_rows(spark, sf_dir)))


def structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The winners of each line are written once: volumes, style, contents and scores all read them."""
    groups = cut(chapters.winners(candidate_rows(spark, sf_dir)))
    totals = cut(document_lines(spark, sf_dir).groupBy("doc_id").agg(F.max("line_no").alias("n_lines")))
    return chapters.resolve(groups, chapters.volumes(groups), chapters.style_profile(groups), chapters.toc_blocks(groups, totals), totals)


@query()
def chapter_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolved chapters; contents runs restart, so there is no SQL for the whole."""
    return structure(spark, sf_dir).select("doc_id", "anchor_line", "rule_id", "serial", "final_score", "state", "chapter_index", "content_start", "content_end")


@query()
def structure_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chapters.structure_summary(structure(spark, sf_dir)).select("doc_id", "n_confirmed", "n_provisional", "n_rejected", "n_toc_entry", "families")


@query(
    """WITH o AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_partkey END AS serial FROM lineitem)
    SELECT l_orderkey, l_linenumber, min(serial) AS serial, last_value(serial IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_serial, first_value(serial IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_serial FROM (SELECT l_orderkey, l_linenumber, max(serial) AS serial FROM o GROUP BY ALL) GROUP BY l_orderkey, l_linenumber, serial"""
)
def serial_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest earlier and later serials: an order is a document, a line item a line, returned parts have no serial."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") != "R", F.col("l_partkey")).alias("serial")).groupBy("l_orderkey", "l_linenumber").agg(F.max("serial").alias("serial"))
    got = chapters.serial_context(rows.withColumnRenamed("l_linenumber", "line_no").withColumn("raw_title", F.lit("")), "l_orderkey")
    return got.select("l_orderkey", F.col("line_no").alias("l_linenumber"), "serial", "prev_serial", "next_serial")


@query(
    """WITH v AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS volume_index FROM orders WHERE o_orderpriority LIKE '1%')
    SELECT o.o_custkey, o.o_orderkey, (SELECT max(volume_index) FROM v WHERE v.o_custkey = o.o_custkey AND v.o_orderkey <= o.o_orderkey)::INT AS volume_index FROM orders o"""
)
def running_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The volume that runs at each order: urgent orders of a customer are its volume titles."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    from pyspark.sql import Window as W

    vols = orders.where(F.col("o_orderpriority").startswith("1")).withColumn("volume_index", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")))
    return asof.asof_last(orders.select("o_custkey", "o_orderkey"), vols, "o_custkey", "o_orderkey", ["volume_index"]).select("o_custkey", "o_orderkey", F.col("asof_volume_index").alias("volume_index"))


@query(
    """WITH a AS (SELECT o_custkey, o_orderkey, lead(o_orderkey) OVER w AS nxt, row_number() OVER w - 1 AS ordinal FROM orders WHERE o_orderstatus = 'F' WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)), e AS (SELECT o_custkey, max(o_orderkey) AS eof FROM orders GROUP BY ALL)
    SELECT o_custkey, o_orderkey, ordinal::INT AS ordinal, (o_orderkey + 1) AS start_line, greatest(least(coalesce(nxt + 1 - 1, eof), greatest(least(o_orderkey + 1, eof), eof)), least(o_orderkey + 1, greatest(eof, 1))) AS end_raw FROM a JOIN e USING (o_custkey)"""
)
def canonical_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense ordinals and recomputed intervals: a customer is a document and a filled order a confirmed chapter."""
    orders = table(spark, sf_dir, "orders")
    from pyspark.sql import Window as W

    rows = orders.select("o_custkey", "o_orderkey", F.max("o_orderkey").over(W.partitionBy("o_custkey")).alias("eof"), F.when(F.col("o_orderstatus") == "F", "CONFIRMED").otherwise("REJECTED").alias("state")).withColumn("content_start", F.col("o_orderkey") + 1)
    got = chapters.canonical(rows, "eof", "o_custkey", "o_orderkey")
    return got.select("o_custkey", "o_orderkey", "ordinal", F.col("content_start").alias("start_line"), F.col("end_line").alias("end_raw"))


@query("SELECT o_custkey, o_orderkey, coalesce(lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1, (SELECT max(o_orderkey) FROM orders)) AS end_key FROM orders")
def interval_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends of intervals: the next anchor less one, or the end of all."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    eof = orders.agg(F.max("o_orderkey").alias("eof"))
    return orders.crossJoin(F.broadcast(eof)).select("o_custkey", "o_orderkey", chapters.interval_end(F.col("o_orderkey"), F.lit(True), F.col("eof"), ["o_custkey"]).alias("end_key"))


@query("SELECT o_orderkey, (o_orderkey % 10000)::INT AS value, (o_orderkey % 10000)::INT AS by_units, (10000 * (1 + o_orderkey % 7) + o_orderkey % 10000)::INT AS large, CASE WHEN o_orderkey % 10 = 0 THEN 10 ELSE (10 + o_orderkey % 10) END::INT AS bare_ten, (o_orderkey % 10)::INT AS bare_hundred FROM orders")
def numeral_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order keys written in Chinese and read back: digits by place, with units, with ten-thousands, and units without a digit before them."""
    n, digits = F.col("o_orderkey") % 10000, "〇一二三四五六七八九"
    at = lambda i: F.translate((F.floor(n / 10**i) % 10).cast("string"), "0123456789", digits)
    units = F.concat(*(F.when(F.floor(n / 10**i) % 10 > 0, F.concat(at(i), F.lit(u))).otherwise("") for i, u in ((3, "千"), (2, "百"), (1, "十"), (0, ""))))
    thousands = F.translate((1 + F.col("o_orderkey") % 7).cast("string"), "0123456789", digits)
    plain = F.translate(n.cast("string"), "0123456789", digits)
    text = lambda c: parse_numeral(F.when(c == "", "零").otherwise(c))
    return table(spark, sf_dir, "orders").select("o_orderkey", text(plain).alias("value"), text(units).alias("by_units"), parse_numeral(F.concat(thousands, F.lit("万"), units)).alias("large"), parse_numeral(F.concat(F.lit("十"), F.when(n % 10 > 0, at(0)).otherwise(""))).alias("bare_ten"), parse_numeral(F.concat(F.lit("百"), at(0))).alias("bare_hundred"))


@query(
    """WITH t AS (SELECT conv_id, turn, '«' || replace(coalesce(text, ''), chr(10), ' ') || '» said ' || role || '.' AS x FROM conversations)
    SELECT conv_id, turn, i::INT AS segment_index, CASE WHEN i = 0 THEN 'SPEECH' ELSE 'NARRATION' END AS type, (CASE WHEN i = 0 THEN 0 ELSE length(split_part(x, '» said ', 1)) + 1 END)::INT AS start, (CASE WHEN i = 0 THEN length(split_part(x, '» said ', 1)) + 1 ELSE length(x) END)::INT AS "end" FROM t, (VALUES (0), (1)) AS v(i)"""
)
def speech_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns written as quoted speech with a cue after it, cut into speech and narration."""
    text = F.concat(F.lit("«"), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")), F.lit("» said "), F.col("role"), F.lit("."))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("text"))
    return segments.explode_segments(rows, ["conv_id"], "turn", LATIN.quotes).select("conv_id", "turn", "segment_index", "type", "start", "end")
