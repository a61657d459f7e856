"""Queries on names, cues and mentions, over the words of the tables. A few still give each order one of some written sentences of the default script by its key; the SQL states what each must give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.functions.text import sentences
from folio.lexicon import CHINESE
from folio.operators import chapters, discovery, evaluation, lines, mentions, names, sampling, segments
from folio.plans.base import query, table
from folio.plans.datasets import SURFACES, surfaces
from folio.plans.records import order_key, orders, pick
from folio.sources import readers


def told(cases: list[tuple], key: str = "o_orderkey") -> str:
    """What the cases give, as a DuckDB list that an order's key picks from."""
    word = lambda x: "NULL" if x is None else str(x) if isinstance(x, int | float) else "'" + str(x).replace("'", "''") + "'"
    return f"[{', '.join(word(c[-1]) for c in cases)}][1 + {key} % {len(cases)}]"


LINKS = " (?:of|de|der|la|que) "


@query(
    f"""WITH c AS (SELECT conv_id, turn, trim(coalesce(text, ''), ' ') AS t FROM conversations), p AS (SELECT *, regexp_split_to_array(t, '{LINKS}') AS a, regexp_extract_all(t, '{LINKS}') AS v FROM c),
    h AS (SELECT conv_id, turn, regexp_split_to_array(left(t, length(t) - length(a[-1]) - length(v[-1])), '[，。！？；：、\\s]') AS b, len(v) AS n FROM p)
    SELECT conv_id, turn, CASE WHEN n > 0 AND regexp_full_match(list_filter(b, lambda x: trim(x) <> '')[-1], '[A-Za-z]{{2,12}}') THEN list_filter(b, lambda x: trim(x) <> '')[-1] END AS speaker FROM h"""
)
def spoken_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word before the last linking word of each turn, if it is one of plain letters."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("t"))
    return rows.select("conv_id", "turn", segments.cue_speaker(F.col("t"), verbs=LINKS, name="^[A-Za-z]{2,12}$").alias("speaker"))


KNOWN_CUES = [("深吸一口气，雷老虎上前一步，拱手抱拳道：", "雷老虎"), ("雷老虎也失笑的摇了摇头：", "雷老虎"), ("对刘三刀道：", "刘三刀"), ("刘三刀追赶道：", "刘三刀"), ("陌生客道：", "陌生客"), ("她说：", None), ("张三看着雷老虎笑道：“", "雷老虎"), ("没有冒号", None), ("刘三刀和雷老虎一起：", "刘三刀")]


@query(f"SELECT o_orderkey, {told(KNOWN_CUES)} AS speaker FROM orders")
def known_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who is cued where two names are known: in an earlier block, before a colon, behind a particle, with a rest behind the name."""
    known = F.array(F.lit("雷老虎"), F.lit("刘三刀"))
    return orders(spark, sf_dir).select("o_orderkey", segments.cue_speaker(pick(order_key(), *(c for c, _ in KNOWN_CUES)), known).alias("speaker"))


DELIVERIES = [
    ("哈哈", "amused/INTERJECTION"), ("咦", "curious/INTERJECTION"), ("噢", "interjection/INTERJECTION"), ("冷冷地", None), ("淡淡地", "calm/SUFFIX"), ("饶有兴致", "interested/PHRASE"), ("边跑边", "hurried/PARALLEL"), ("大声", None), ("沉声", "grave/STEM"), ("王小明", None), ("似笑非笑", "sardonic/PHRASE"),
    ("慢慢地", "-/SUFFIX"), ("李喜", None), ("轻轻叹息", "weary/STEM"), ("很不耐烦地", "impatient/SUFFIX"), ("UNKNOWN", None), ("一二三四五六七", None),
]


@query(f"SELECT o_orderkey, {told(DELIVERIES)} AS cue FROM orders")
def delivery_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a surface says of delivery and by which rule; a known name is none, but an interjection always is."""
    cue = names.delivery_cue(pick(order_key(), *(c for c, _ in DELIVERIES)), F.array(F.lit("哈哈"), F.lit("冷冷地")))
    rows = orders(spark, sf_dir).select("o_orderkey", cue.alias("c"))
    return rows.select("o_orderkey", F.when(F.col("c").isNotNull(), F.concat_ws("/", F.coalesce("c.hint", F.lit("-")), "c.matched_by")).alias("cue"))


CLASSES = [
    ("虽然", "FUNCTION_WORD", "f", "t"), ("拱手", "ACTION_WORD", "f", "t"), ("为李寄舟", "PREP_PREFIX", "f", "t"), ("这位婶娘", "FUNCTION_WORD", "f", "t"), ("那人啊", "DEMON_PREFIX", "f", "t"), ("很好听", "FUNCTION_WORD", "f", "f"), ("两人", "FUNCTION_WORD", "t", "t"), ("仰脖子", "ACTION_WORD", "f", "t"), ("哈", "INTERJECTION", "f", "f"), ("王", "BAD_FINAL", "f", "f"),
    ("张三的", "BAD_FINAL", "f", "f"), ("空闻大师", None, "f", "t"), ("王小明", None, "f", "t"), ("笑先生", "BAD_FINAL", "f", "t"), ("弟子们", None, "t", "t"), ("abc", None, "f", "f"), ("莫将", None, "f", "t"),
]


@query(f"SELECT o_orderkey, {told([(c[1],) for c in CLASSES])} AS reject, {told([(c[2],) for c in CLASSES])} = 't' AS is_group, {told([(c[3],) for c in CLASSES])} = 't' AS candidate FROM orders")
def surface_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surfaces that no name may be, groups of people, and forms of a candidate."""
    s = pick(order_key(), *(c[0] for c in CLASSES))
    return orders(spark, sf_dir).select("o_orderkey", names.hard_reject(s).alias("reject"), names.is_group(s).alias("is_group"), names.candidate_ok(s).alias("candidate"))


FUNCTION_WORDS = "the of and to in is that for with as le la les de des et un une que qui der die das und ein el los del una".split()
#: Counts of benchmark words among the turns, left to right without overlaps, by cutting each text at the word.
EVIDENCE = f"""{SURFACES}, c AS (SELECT coalesce(text, '') AS t FROM conversations), p AS (SELECT surface, string_split(t, surface) AS a FROM c, s WHERE contains(t, surface)), i AS (SELECT surface, a, unnest(range(1, len(a))) AS i FROM p),
h AS (SELECT surface, CASE WHEN a[i] <> '' THEN right(a[i], 1) WHEN i > 1 THEN right(surface, 1) ELSE '' END AS l, CASE WHEN a[i + 1] <> '' THEN left(a[i + 1], 1) WHEN i + 1 < len(a) THEN left(surface, 1) ELSE '' END AS r FROM i),
ev AS (SELECT s.surface, count(h.r) AS total, count(*) FILTER (r IN (':', '?')) AS cue_bound, count(DISTINCT r) AS right_kinds, count(*) FILTER (l IN ('', ' ', chr(10), ',', '.') AND r NOT IN (':', '?')) AS independent, count(*) FILTER (r IN (':', '|')) AS quote_right, count(*) FILTER (l IN ('', ' ', chr(10), ',', '.')) AS punct_left, count(*) FILTER (l = 'e') AS person_object FROM s LEFT JOIN h USING (surface) GROUP BY s.surface)"""
GATED = f"""{EVIDENCE}, w AS (SELECT *, CASE WHEN lower(surface) IN ({', '.join(repr(x) for x in FUNCTION_WORDS)}) THEN 'FUNCTION_WORD' END AS word, CASE WHEN total = 0 OR right_kinds < 3 THEN 'CUE_ONLY' WHEN independent < 1 THEN 'NO_INDEPENDENT' END AS counts FROM ev),
k AS (SELECT w.surface, list(length(x.surface) ORDER BY length(x.surface)) AS able FROM w JOIN w x ON starts_with(w.surface, x.surface) AND length(x.surface) < length(w.surface) AND x.word IS NULL AND x.counts IS NULL GROUP BY w.surface),
d AS (SELECT surface, list_reduce(able, lambda a, x: CASE WHEN len(list_filter(a, lambda j: x - j <= 2 AND substr(surface, j + 1, x - j) <> 'ly')) = 0 THEN list_append(a, x) ELSE a END, []::BIGINT[]) AS names FROM k),
e AS (SELECT surface, list_filter(names, lambda j: length(surface) - j <= 2 AND substr(surface, j + 1) <> 'ly')[1] AS cut FROM d),
g AS (SELECT surface, CASE WHEN word IS NULL AND cut IS NOT NULL THEN left(surface, cut) END AS residue_of, coalesce(word, CASE WHEN cut IS NOT NULL THEN 'NAME_PLUS_RESIDUE' END, counts) AS reject FROM w LEFT JOIN e USING (surface))"""


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.surface_evidence(table(spark, sf_dir, "conversations"), surfaces(spark, sf_dir), cue_heads=":?", punct=" \n,.", overlapping=False, quotes=":|", takers="e")


def gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words through the gate, by their places in the conversations; articles and the like are no names, and -ly is a title."""
    return names.gate(evidence(spark, sf_dir), word=F.when(F.lower("surface").isin(*FUNCTION_WORDS), "FUNCTION_WORD"), titles=["ly"])


@query(f"WITH {EVIDENCE} SELECT surface, total, cue_bound, right_kinds, independent, total - cue_bound AS free, quote_right, punct_left, person_object FROM ev")
def surface_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All counters of each word, matches left to right without overlaps."""
    return evidence(spark, sf_dir)


@query(f"WITH {GATED} SELECT surface, reject, residue_of FROM g")
def name_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names by closed classes, residues of accepted names and corpus counts, in this order."""
    return gated(spark, sf_dir).select("surface", "reject", "residue_of")


@query(f"WITH {GATED}, r AS (SELECT coalesce(reject, 'ACCEPTED') AS reason, reject FROM g) SELECT reason, count(*) AS n, round((SELECT count(reject) / count(*) FROM r), 6) AS pollution_rate FROM r GROUP BY reason")
def gate_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.gate_summary(gated(spark, sf_dir)).withColumn("pollution_rate", F.round("pollution_rate", 6))


@query(
    f"""WITH {GATED}, n AS (SELECT DISTINCT w FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM documents)), r AS (SELECT CASE WHEN w IS NULL THEN 'fragment' ELSE 'name' END AS label, coalesce(reject, 'ACCEPTED') AS reason FROM g LEFT JOIN n ON w = surface)
    SELECT label, reason, count(*) AS n, round(sum(count(*) FILTER ((label = 'name') = (reason = 'ACCEPTED'))) OVER (PARTITION BY label) / sum(count(*)) OVER (PARTITION BY label), 6) AS right_share FROM r GROUP BY label, reason"""
)
def gate_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate against labels: words that a document has as whole words are names, all others fragments."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1))).alias("surface"), F.lit("name").alias("label"))
    return evaluation.gate_probe(gated(spark, sf_dir), words)


SUBJECTS = [("深吸一口气，雷老虎上前一步，拱手抱拳道：“走”", "拱手抱,拱手抱拳,雷老虎,雷老虎上"), ("他走了，又说", ""), ("刘三刀摇头说", "刘三刀,刘三刀摇"), ("没有", ""), ("abc，王小明：", "王小明")]


@query(f"SELECT o_orderkey, {told(SUBJECTS)} AS subjects FROM orders")
def proposed_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).select("o_orderkey", F.array_join(segments.subjects(pick(order_key(), *(c for c, _ in SUBJECTS))), ",").alias("subjects"))


VARIANTS = [("对闫呢", "闫呢"), ("指着甜妹", "甜妹"), ("小王明", "小王明"), ("向一二三四五", "向一二三四五"), ("和平", "和平")]
CALLED = [("“张三，你来。", "张三"), ("你好，", ""), ("欧阳戎！", "欧阳戎"), ("一二三四五，", ""), ("嗯，走", ""), ("走。", "")]
INTRODUCED = [("我是张三。我叫李四", "张三,李四"), ("在下雷老虎是也", "雷老虎是"), ("没有", ""), ("本座 ", "")]
SUBJECT_CASES = [
    ("方夫人扑上前来，跪在欧阳戎脚边，哭泣叫冤", "方夫人扑,方夫人,方夫,欧阳戎脚,欧阳戎,欧阳,哭泣"), ("忽然张三说", "张三"), ("蒙江兄笑道", "蒙江兄,蒙江"), ("西城县令高传式问道", "西城县令,西城县,西城,高传式,高传式,高传"), ("已过四旬的方夫人道", "已过四旬,已过四,已过,方夫人"), ("张三看着李四的背影道", "张三"), ("没有", ""), ("天黑。李四说", "李四"),
]


@query(f"SELECT o_orderkey, {told(VARIANTS)} AS variants, {told(CALLED)} AS called, {told(INTRODUCED)} AS introduced, {told(SUBJECT_CASES)} AS subjects FROM orders")
def mention_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names behind particles, called, introduced, and before verbs of saying."""
    of = lambda cases: pick(order_key(), *(c for c, _ in cases))
    joined = lambda c, n: F.array_join(c, ",").alias(n)
    return orders(spark, sf_dir).select("o_orderkey", joined(names.name_variants(of(VARIANTS)), "variants"), joined(mentions.called(of(CALLED)), "called"), joined(mentions.introduced(of(INTRODUCED)), "introduced"), joined(mentions.cue_subjects(of(SUBJECT_CASES)), "subjects"))


@query(
    """WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS t FROM conversations), x AS (SELECT *, lag(t, 1, '') OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM c),
    m AS (SELECT role, conv_id, turn, 'vocative' AS kind, regexp_extract(trim(t, ' '), '^([A-Za-z]{2,12})[，,！!？?。.；;：:、\\s]', 1) AS surface FROM x UNION ALL SELECT role, conv_id, turn, 'self_intro', unnest(regexp_extract_all(t, '(?: is | est | ist )([A-Za-z]{2,12})', 1)) FROM x UNION ALL SELECT role, conv_id, turn, 'cue', unnest(regexp_extract_all(before, '([A-Za-z]{2,12}),', 1)) FROM x),
    k AS (SELECT * FROM m WHERE surface <> '' AND NOT (kind = 'vocative' AND left(surface, 1) IN ('A', 'I')))
    SELECT role, surface, count(*) AS total, count(*) FILTER (kind = 'vocative') AS vocative, count(*) FILTER (kind = 'self_intro') AS self_intro, count(*) FILTER (kind = 'cue') AS cue, count(DISTINCT conv_id) AS n_buckets, min(turn) AS first, max(turn) AS last,
        round(count(*) FILTER (kind = 'vocative') * 14.0::DOUBLE + count(*) FILTER (kind = 'self_intro') * 16.0 + count(*) FILTER (kind = 'cue') * 12.0 + least(count(*), 50) * 1.2 + CASE WHEN count(DISTINCT conv_id) >= 3 THEN 3 ELSE 0 END, 1) AS confidence FROM k GROUP BY role, surface"""
)
def mention_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which words begin a turn, follow a word of being, or stand before a comma in the turn before, by role, with places, conversations and a confidence."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("t"))
    rows = rows.withColumn("before", F.lag("t", 1, "").over(W.partitionBy("conv_id").orderBy("turn")))
    name = "[A-Za-z]{2,12}"
    kinds = [("vocative", mentions.called(F.col("t"), name, ["A", "I"])), ("self_intro", mentions.introduced(F.col("t"), [" is ", " est ", " ist "], name)), ("cue", F.regexp_extract_all("before", F.lit(f"({name}),"), F.lit(1)))]
    return mentions.mention_lexicon(mentions.mention_rows(rows, ["role", "conv_id"], "turn", kinds=kinds), ["role"], "turn", "conv_id").drop("narrative")


MENTION_SQL = """WITH d AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '([A-Z][a-z]+),', 1)) AS n FROM documents), c AS (SELECT doc_id, CASE WHEN n = 0 THEN 'NONE' WHEN n >= 3 THEN 'multi_person' ELSE 'foreign_name' END AS kind FROM d)"""


def mention_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", mentions.mention_class(F.regexp_extract_all(t, F.lit("([A-Z][a-z]+),"), F.lit(1)), t).alias("kind"))


@query(f"{MENTION_SQL} SELECT doc_id, kind FROM c")
def mention_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of each document by its words with a capital before a comma; the classes of the default script have tests."""
    return mention_cases(spark, sf_dir)


@query(f"{MENTION_SQL} SELECT doc_id, kind FROM c QUALIFY row_number() OVER (PARTITION BY kind ORDER BY doc_id) <= 300 // 9")
def mention_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equally many samples of each of nine classes, 300 in all at most: the quota is the feature."""
    return sampling.equal_quota(mention_cases(spark, sf_dir), "kind", 300, 9, F.col("doc_id"))


@query(
    r"""WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations), x AS (SELECT *, lag(t, 1, '') OVER w AS p1, lag(t, 2, '') OVER w AS p2, first_value(t) OVER w AS t0 FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    o AS (SELECT conv_id, turn, p1, p2, regexp_extract_all(t, '([A-Z][a-z]+),', 1) AS cues, regexp_extract_all(t, '[A-Z][a-z]+') AS said, regexp_extract_all(t0, '[A-Z][a-z]+') AS known FROM x),
    h AS (SELECT *, list_filter(list_concat(regexp_split_to_array(p1, '[，。！？；：、\s“”"《》]'), regexp_split_to_array(p2, '[，。！？；：、\s“”"《》]')), lambda b: b <> '') AS blocks FROM o),
    r AS (SELECT *, list_sort(list_distinct(list_transform(blocks, lambda b: CASE WHEN regexp_matches(b, '^[A-Z][a-z]{1,3}$') THEN CASE WHEN list_contains(known, b) THEN b END WHEN length(b) > 4 THEN list_filter([left(b, 4), left(b, 3), left(b, 2)], lambda y: regexp_matches(y, '^[A-Z][a-z]{1,3}$') AND list_contains(known, y))[1] END))) AS recent FROM h),
    s AS (SELECT conv_id, turn, 'CUE' AS source, unnest(cues) AS surface, 0 AS p, unnest(range(len(cues))) AS i FROM r UNION ALL SELECT conv_id, turn, 'AI_MENTION', unnest(said), 1, unnest(range(len(said))) FROM r UNION ALL SELECT conv_id, turn, 'RECENT_MENTION', unnest(recent), 2, unnest(range(len(recent))) FROM r
        UNION ALL SELECT conv_id, turn, 'SCENE_ACTIVE', regexp_extract(p1, '[A-Z][a-z]+'), 3, 0 FROM r UNION ALL SELECT conv_id, turn, 'NEW_MENTION', unnest(said), 4, unnest(range(len(said))) FROM r),
    g AS (SELECT s.* FROM s JOIN r USING (conv_id, turn) WHERE surface <> '' AND CASE source WHEN 'AI_MENTION' THEN list_contains(known, surface) WHEN 'NEW_MENTION' THEN NOT list_contains(known, surface) ELSE true END),
    f AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY conv_id, turn, surface ORDER BY p, i) = 1)
    SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY p, i) - 1 AS nth, surface, source FROM f"""
)
def candidate_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of each turn from five sources in order, each word once; entities are the words with a capital of the conversation's first turn, recent mentions come from the blocks of the two turns before."""
    w = W.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("t"))
    rows = rows.select("*", F.lag("t", 1, "").over(w).alias("p1"), F.lag("t", 2, "").over(w).alias("p2"), F.first("t").over(w).alias("t0"))
    words = lambda c, p="([A-Z][a-z]+)": F.regexp_extract_all(c, F.lit(p), F.lit(1))
    known = words("t0")
    recent = mentions.head_mentions(F.array("p1", "p2"), known, "^[A-Z][a-z]{1,3}$")
    store = mentions.candidate_store(words("t", "([A-Z][a-z]+),"), words("t"), recent, F.slice(words("p1"), 1, 1), known)
    return rows.select("conv_id", "turn", F.posexplode(store).alias("nth", "c")).select("conv_id", "turn", F.col("nth").cast("long").alias("nth"), "c.surface", "c.source")


BINDINGS = [
    ("VOICE_OVERRIDE_SET", "张三的声音变得沙哑", "C0/NONE/BOUND/张三的声音变"), ("VOICE_OVERRIDE_SET", "听见张三的声音变了", "UNKNOWN/UNKNOWN/PENDING/-"), ("VOICE_OVERRIDE_SET", "李四模仿王五的语气说", "C1/C2/BOUND/李四模仿王五的语气"), ("VOICE_OVERRIDE_SET", "路人模仿王五的语气", "UNKNOWN/C2/PENDING/路人模仿王五的语气"),
    ("VOICE_OVERRIDE_CLEAR", "张三恢复了自己的声音", "C0/NONE/BOUND/张三恢复了自己的声音"), ("NONE", "张三的声音变了", "UNKNOWN/UNKNOWN/PENDING/-"), ("PERFORMANCE", "路人的嗓音突然变", "UNKNOWN/UNKNOWN/PENDING/-"), ("VOICE_OVERRIDE_CLEAR", "没有", "UNKNOWN/UNKNOWN/PENDING/-"),
]


@query(f"SELECT o_orderkey, {told(BINDINGS)} AS binding FROM orders")
def sure_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whose voice an event changes, where the text leaves no doubt."""
    candidates = F.array(*(F.struct(F.lit(r).alias("role"), F.lit(n).alias("name")) for r, n in (("C0", "张三"), ("C1", "李四"), ("C2", "王五"))))
    b = mentions.sure_binding(pick(order_key(), *(c[0] for c in BINDINGS)), pick(order_key(), *(c[1] for c in BINDINGS)), candidates)
    return orders(spark, sf_dir).select("o_orderkey", F.concat_ws("/", b["owner"], b["reference"], b["status"], F.coalesce(b["span"], F.lit("-"))).alias("binding"))


@query("SELECT x.surface, x.book, true AS in_first, x.book % 2 = 0 OR y.surface IS NOT NULL AS in_second FROM (SELECT DISTINCT 'n' || o_custkey % 30 AS surface, o_custkey % 10 AS book FROM orders) x LEFT JOIN (SELECT 'n3' AS surface) y USING (surface) UNION ALL SELECT 'extra', book, false, true FROM (SELECT DISTINCT o_custkey % 10 AS book FROM orders)")
def united_harvests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two harvests of names and in which of them each stands: their union, intersection and differences."""
    first = orders(spark, sf_dir).select(F.concat(F.lit("n"), (F.col("o_custkey") % 30).cast("string")).alias("surface"), (F.col("o_custkey") % 10).alias("book"))
    second = first.where("book % 2 = 0 or surface = 'n3'").unionByName(first.select(F.lit("extra").alias("surface"), "book"))
    return sampling.united(first, second, ["surface", "book"])


@query("SELECT o_orderstatus, count(DISTINCT o_custkey) AS n_o_custkey, count(DISTINCT o_orderpriority) AS n_o_orderpriority FROM orders GROUP BY o_orderstatus")
def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.distinct_counts(orders(spark, sf_dir), ["o_custkey", "o_orderpriority"], ["o_orderstatus"])


@query(
    """WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS surface FROM conversations), n AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS name FROM benchmark)
    SELECT surface, name, substr(surface, length(name) + 1) AS rest FROM w JOIN n ON length(surface) >= 3 AND name IN (left(surface, length(surface) - 1), left(surface, length(surface) - 2)) AND length(name) >= 2 QUALIFY row_number() OVER (PARTITION BY surface ORDER BY length(name) DESC) = 1"""
)
def name_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the conversations that are a benchmark word and one or two letters more."""
    words = lambda name: table(spark, sf_dir, name).select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1))).alias("surface")).distinct()
    return names.longest_prefix(words("conversations"), words("benchmark"))


@query("SELECT conv_id, turn, i - 1 AS nth, w AS surface FROM (SELECT conv_id, turn, unnest(regexp_extract_all(text, 'them|then|the|and|he|an')) AS w, generate_subscripts(regexp_extract_all(text, 'them|then|the|and|he|an'), 1) AS i FROM conversations)")
def greedy_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From left to right, the longest dictionary word at each place outside the match before."""
    words = spark.createDataFrame([(w,) for w in ("the", "them", "then", "he", "an", "and")], "surface string")
    got = names.longest_matches(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), words, ["conv_id", "turn"])
    return got.select("conv_id", "turn", F.col("nth").cast("long").alias("nth"), "surface")


@query(
    """WITH s AS (SELECT l_orderkey, l_returnflag || l_linestatus AS surface, l_linestatus AS source, l_linenumber % 2 AS source_rank, l_linenumber AS place FROM lineitem), f AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY l_orderkey, surface ORDER BY source_rank, place) = 1)
    SELECT l_orderkey, surface, source_rank, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY source_rank, place, surface) AS rank FROM f) WHERE rank <= 2"""
)
def compiled_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of each order by source, first seen kept, two at most: the cap is the feature."""
    s = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat("l_returnflag", "l_linestatus").alias("surface"), F.col("l_linestatus").alias("source"), (F.col("l_linenumber") % 2).alias("source_rank"), F.col("l_linenumber").alias("place"))
    return names.compile_candidates(s, ["l_orderkey"], 2).select("l_orderkey", "surface", "source_rank", "rank")


@query(
    """WITH o AS (SELECT l_orderkey, l_returnflag AS kind, l_linenumber AS place, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber) AS r FROM lineitem WHERE l_returnflag IN ('R', 'N')), b AS (SELECT * FROM o WHERE r <= CASE kind WHEN 'R' THEN 1 ELSE 2 END),
    n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE kind WHEN 'R' THEN 0 ELSE 1 END, place) AS i FROM b) SELECT l_orderkey, kind, place, 'E' || i AS evidence_id FROM n WHERE i <= 2"""
)
def evidence_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most so much evidence of each kind and in all, numbered in the order of the kinds: the budgets are the feature."""
    e = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("kind"), F.col("l_linenumber").alias("place"))
    return names.evidence_budget(e, ["l_orderkey"], {"R": 1, "N": 2}, total=2).select("l_orderkey", "kind", "place", "evidence_id")


@query("WITH c AS (SELECT o_custkey, o_orderpriority AS surface, count(*) AS n, min(o_orderkey) AS candidate_id FROM orders GROUP BY ALL) SELECT o.o_orderkey, CASE WHEN c.n = 1 THEN c.candidate_id END AS candidate_id FROM orders o JOIN c ON c.o_custkey = o.o_custkey AND c.surface = o.o_orderpriority")
def unique_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate of a surface where exactly one of its key has it."""
    o = orders(spark, sf_dir).withColumn("surface", F.col("o_orderpriority"))
    return names.unique_lookup(o.select("o_orderkey", "o_custkey", "surface"), o.select("o_custkey", "surface", order_key().alias("candidate_id")), ["o_custkey"]).select("o_orderkey", "candidate_id")


GAP = "[^。！？.!?]{0,12}"
JOINED = lambda cues: f"(regexp_matches(t, a || '{GAP}(?:{cues}){GAP}' || b) OR regexp_matches(t, b || '{GAP}(?:{cues}){GAP}' || a))"


@query(
    f"""WITH c AS (SELECT conv_id, turn, text AS t, regexp_extract_all(text, '[A-Z][a-z]+') AS w FROM conversations), n AS (SELECT *, w[1] AS a, w[2] AS b FROM c WHERE len(w) >= 2)
    SELECT conv_id, turn, {JOINED(' is | est | ist | es ')} AS same, CASE WHEN {JOINED(' not | pas ')} THEN 'DENIED' WHEN {JOINED('[.]|, ')} THEN 'APART' END AS other FROM n"""
)
def alias_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a sentence of a turn says that its first two words with a capital are one, or two."""
    w = F.regexp_extract_all("text", F.lit("([A-Z][a-z]+)"), F.lit(1))
    rows = table(spark, sf_dir, "conversations").where(F.size(w) >= 2).select("conv_id", "turn", "text", F.get(w, F.lit(0)).alias("a"), F.get(w, F.lit(1)).alias("b"))
    a, b, t = F.col("a"), F.col("b"), F.col("text")
    return rows.select("conv_id", "turn", names.alias_evidence(a, b, t, " is | est | ist | es ").alias("same"), names.contradiction_evidence(a, b, t, [("DENIED", " not | pas "), ("APART", "[.]|, ")]).alias("other"))


SPOKEN_SQL = """t AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN '张三' ELSE '李四' END AS n FROM conversations), p AS (SELECT *, CASE WHEN turn % 4 < 2 THEN n END AS named FROM t WHERE turn % 4 < 3),
q AS (SELECT *, last_value(named IGNORE NULLS) OVER w AS last, coalesce(bool_or(named = '张三') OVER w, false) AND coalesce(bool_or(named = '李四') OVER w, false) AS both_ FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query(
    f"""WITH {SPOKEN_SQL} SELECT conv_id, turn, coalesce(named, CASE WHEN both_ THEN CASE last WHEN '张三' THEN '李四' ELSE '张三' END ELSE last END) AS speaker,
    CASE WHEN named IS NOT NULL THEN CASE turn % 4 WHEN 0 THEN 'EXPLICIT_SPEECH_CUE' ELSE 'POSTPOSED_SPEECH_CUE' END WHEN last IS NOT NULL THEN 'TURN_TRACKING' ELSE 'UNKNOWN' END AS provenance FROM q"""
)
def assigned_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speakers of turns written as quotations: cued before, cued after, not at all (then by turn), or narration."""
    name = F.when(F.col("role") == "user", "张三").otherwise("李四")
    said = F.concat(F.lit("“"), F.left(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z ]", ""), F.lit(20)), F.lit("x”"))
    turn = F.col("turn") % 4
    text = F.when(turn == 0, F.concat(name, F.lit("说："), said)).when(turn == 1, F.concat(said, name, F.lit("答道。"))).when(turn == 2, said).otherwise("天色已晚。")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("text"))
    cued = segments.cue_columns(segments.explode_segments(rows, ["conv_id"], "turn", CHINESE.quotes), ["conv_id"], "turn")
    return segments.assign_speakers(cued, ["conv_id"], "turn").select("conv_id", "turn", "speaker", "provenance")


@query(
    """WITH b AS (SELECT DISTINCT o_custkey % 10 AS book, o_orderkey % 3 AS k FROM orders), h AS (SELECT DISTINCT book, x.surface, x.reject FROM b, (VALUES (0, '雷老虎', NULL), (1, '虽然不知', 'FUNCTION_WORD'), (2, '王小明', NULL)) AS x(k, surface, reject) WHERE b.k = x.k) SELECT book, surface, reject FROM h"""
)
def discovered_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of ten books in three steps: cues harvested, sifted by the gate, and harvested again with the names so accepted."""
    text = pick(order_key(), "雷老虎说：“走。”雷老虎，来了。见雷老虎走。“好。”雷老虎道。雷老虎们", "虽然不知道：“谁？”天黑了。", "王小明问：“何在？”王小明，坐。问王小明去。王小明也笑。")
    rows = orders(spark, sf_dir).select((F.col("o_custkey") % 10).alias("book"), order_key().alias("idx"), text.alias("text"))
    found = discovery.discover(rows, ["book"], "idx", CHINESE.quotes)
    return found.select("book", "surface", "reject")


@query("SELECT l_orderkey, coalesce(min(l_linenumber) FILTER (l_returnflag = 'R'), max(l_linenumber)) AS target_index FROM lineitem GROUP BY l_orderkey")
def target_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first spoken segment of each paragraph, else its last: an order is a paragraph, a returned item speech."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("segment_index"), F.when(F.col("l_returnflag") == "R", "SPEECH").otherwise("NARRATION").alias("type"))
    return segments.target_segment(rows, ["l_orderkey"])


@query("SELECT o_orderkey, o_custkey % 10 AS doc_id, o_orderkey % 50 AS serial FROM orders WHERE o_orderkey % 6 > 0 AND (o_custkey % 10, o_orderkey % 50) IN (SELECT (o_custkey % 10, o_orderkey % 30) FROM orders WHERE o_orderstatus = 'F')")
def toc_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a table of contents whose serial stands in the body."""
    o = orders(spark, sf_dir).withColumn("doc_id", F.col("o_custkey") % 10)
    entries = o.select("o_orderkey", "doc_id", F.when(order_key() % 6 > 0, order_key() % 50).alias("serial"))
    return chapters.toc_body_links(entries, o.where("o_orderstatus = 'F'").select("doc_id", (order_key() % 30).alias("serial"))).select("o_orderkey", "doc_id", "serial")


@query(
    """WITH c AS (SELECT o_custkey AS doc_id, o_orderkey AS anchor_line, o_orderpriority AS title FROM orders), l AS (SELECT * FROM c WHERE anchor_line % 5 > 0)
    SELECT doc_id, anchor_line, CASE WHEN anchor_line % 7 = 0 THEN 'second' ELSE title END AS title, CASE WHEN anchor_line % 3 = 0 THEN CASE WHEN anchor_line % 2 = 0 THEN 'REJECTED' ELSE 'CONFIRMED' END ELSE 'PROVISIONAL' END AS state, CASE WHEN anchor_line % 11 = 0 THEN 4 ELSE 1 END AS volume_index FROM l
    UNION ALL SELECT doc_id, -min(anchor_line), CASE WHEN doc_id % 2 = 0 THEN 'added' ELSE 'New chapter' END, 'CONFIRMED', NULL FROM c GROUP BY doc_id"""
)
def chapter_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's changes to chapters: removed, retitled (the last one counts), retyped, moved to a volume, added."""
    c = orders(spark, sf_dir).select(F.col("o_custkey").alias("doc_id"), order_key().alias("anchor_line"), F.col("o_orderpriority").alias("title"), F.col("o_orderpriority").alias("raw_title"), F.lit("PROVISIONAL").alias("state"), F.lit(1).alias("volume_index"), F.lit(1.0).alias("final_score"), (order_key() + 1).alias("content_start"))
    at = F.col("anchor_line")
    change = lambda rows, kind, value, seq: rows.select("doc_id", F.col("anchor_line").alias("target_line"), F.lit(kind).alias("type"), (value if not isinstance(value, str) else F.lit(value)).cast("string").alias("value"), F.lit(seq).alias("seq"))
    made = [change(c.where(at % 5 == 0), "REMOVE_CHAPTER", F.lit(None), 1), change(c.where(at % 7 == 0), "CHANGE_TITLE", "first", 1), change(c.where(at % 7 == 0), "CHANGE_TITLE", "second", 2), change(c.where(at % 3 == 0), "CHANGE_TYPE", F.when(at % 2 == 0, "REMOVE").otherwise("CHAPTER"), 1), change(c.where(at % 11 == 0), "ASSIGN_VOLUME", "4", 1)]
    added = c.groupBy("doc_id").agg((-F.min("anchor_line")).alias("anchor_line"))
    made.append(change(added, "ADD_CHAPTER", F.when(F.col("doc_id") % 2 == 0, "added").otherwise(""), 1))
    every = made[0]
    for m in made[1:]:
        every = every.unionByName(m)
    return chapters.apply_overrides(c, every).select("doc_id", "anchor_line", "title", "state", "volume_index")


@query(
    """WITH v AS (SELECT o_custkey AS doc_id, o_orderkey % 40 AS chapter_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 + CASE WHEN o_orderkey % 9 = 0 THEN 100 ELSE 0 END AS ordinal, o_orderkey AS anchor_line, o_orderkey + CASE WHEN o_orderkey % 7 = 0 THEN 30 ELSE 1 END AS start_line, o_orderkey + 20 AS end_line, 5000 AS n_lines FROM orders),
    w AS (SELECT *, count(*) OVER (PARTITION BY doc_id, chapter_id) AS c, row_number() OVER o - 1 AS want, lag(end_line) OVER o AS pe, lag(anchor_line) OVER o AS pa FROM v WINDOW o AS (PARTITION BY doc_id ORDER BY ordinal, chapter_id)),
    x AS (SELECT *, array_to_string(list_filter([CASE WHEN c > 1 THEN 'DUPLICATE_ID' END, CASE WHEN chapter_id = 0 THEN 'ZERO_ID' END, CASE WHEN ordinal <> want THEN 'ORDINAL_GAP' END, CASE WHEN start_line > end_line THEN 'INVERTED' END, CASE WHEN start_line <= pe THEN 'OVERLAP' END, CASE WHEN anchor_line <= pa THEN 'ANCHOR_ORDER' END, CASE WHEN end_line > n_lines THEN 'BEYOND_END' END], lambda z: z IS NOT NULL), ',') AS faults FROM w)
    SELECT doc_id, anchor_line, faults FROM x WHERE faults <> ''"""
)
def view_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with each row of a damaged chapter view."""
    o = orders(spark, sf_dir)
    place = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    v = o.select(F.col("o_custkey").alias("doc_id"), (order_key() % 40).alias("chapter_id"), (place + F.when(order_key() % 9 == 0, 100).otherwise(0)).alias("ordinal"), order_key().alias("anchor_line"), (order_key() + F.when(order_key() % 7 == 0, 30).otherwise(1)).alias("start_line"), (order_key() + 20).alias("end_line"), F.lit(5000).alias("n_lines"))
    return chapters.view_violations(v).select("doc_id", "anchor_line", F.array_join("violations", ",").alias("faults"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders) WHERE o_orderstatus = 'F' AND i BETWEEN 2 AND 5")
def scoped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one chapter within a range of indices: filled orders are the chapter."""
    rows = orders(spark, sf_dir).select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") == "F", 7).otherwise(8).alias("chapter_id"), F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")).alias("paragraph_index"))
    return readers.lookup(readers.scope(rows, 7, 2, 5), chapter_id=7).select("o_custkey", "o_orderkey")


@query("SELECT o_orderstatus, count(*) AS n_rows FROM orders WHERE o_orderstatus = 'O' GROUP BY o_orderstatus")
def keyed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan by key whose filter reaches the file, and a count of what is only read."""
    return readers.probe(readers.lookup(table(spark, sf_dir, "orders"), o_orderstatus="O")).select(F.lit("O").alias("o_orderstatus"), "n_rows")


@query("WITH c AS (SELECT conv_id, turn, left(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g'), 40) || repeat(chr(1), (turn % 5)::INT) AS t FROM conversations) SELECT conv_id, turn, (turn % 5) > strlen(t) / 16 AS binary_, len(list_filter(regexp_extract_all(t, '[^x]+'), lambda z: z <> '')) > 0 AS some FROM c")
def binary_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with more control characters than a sixteenth of their bytes are no text."""
    turn = F.col("turn")
    t = F.concat(F.left(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", ""), F.lit(40)), F.repeat(F.lit("\x01"), (turn % 5).cast("int")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", lines.not_text(t).alias("binary_"), (F.size(sentences(t, "x")) > 0).alias("some"))
