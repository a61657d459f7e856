"""Text structure on small literal inputs, and loops against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from folio.functions.numerals import parse_numeral
from folio.functions.text import align, backoff_ms, extract_age, hash_of, join_separator, occurrences, sentences
from folio.lexicon import CHINESE, LATIN
from folio.operators import blocks, boundaries, chapters, layout, lines, paragraphs, segments
from folio.sources import readers


def doc(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_line_breaks_and_counters(spark):
    got = lines.physical_lines(doc(spark, "a\r\nb\rc\n", "", "　　文x \n\n\t y", None)).orderBy("doc_id", "line_no").collect()
    assert [(r.doc_id, r.text, r.newline, r.byte_start, r.char_start) for r in got if r.doc_id == 0] == [(0, "a", "CRLF", 0, 0), (0, "b", "CR", 3, 1), (0, "c", "LF", 5, 2)]
    assert not [r for r in got if r.doc_id in (1, 3)]
    first, blank, last = [r for r in got if r.doc_id == 2]
    assert (first.lead_full, first.trailing_space, first.char_count, first.han_count, first.byte_end) == (2, 1, 5, 1, 11)
    assert blank.is_blank and (last.lead_tab, last.lead_space, last.newline) == (1, 1, "NONE")


@pytest.mark.parametrize(("raw", "charset", "text"), [
    (b"", "UTF-8", ""), (b"abc", "UTF-8", "abc"), (b"\xef\xbb\xbfx", "UTF-8", "x"), ("汉字测试".encode(), "UTF-8", "汉字测试"), ("中文小说第一章".encode("gb18030"), "GBK", "中文小说第一章"), ("㐀中文㐁第一章".encode("gb18030"), "GB18030", "㐀中文㐁第一章"),
    ("x汉字".encode("utf-16"), "UTF-16LE", "x汉字"), ("plain ascii text".encode("utf-16-le"), "UTF-16LE", "plain ascii text"), ("plain ascii text".encode("utf-16-be"), "UTF-16BE", "plain ascii text"), (b"\xff\xff\xff", "UTF-8", None),
])
def test_charsets(raw, charset, text):
    got = readers.detect(raw)
    assert (got["charset"], got["text"]) == (charset, text)


def test_decode_contents(spark):
    rows = spark.createDataFrame([("a", bytearray(b"hello")), ("b", bytearray(b"\x00\x01\x02" * 50)), ("c", bytearray(b"\xff\xff"))], "path string, content binary")
    assert {r.path: (r.error, r.text) for r in readers.decode_contents(rows).collect()} == {"a": (None, "hello"), "b": ("NOT_TEXT", None), "c": ("UNDECODABLE", None)}


@pytest.mark.parametrize(("text", "value"), [("12", 12), ("１２", 12), ("十", 10), ("二十三", 23), ("一百零五", 105), ("三千〇二十", 3020), ("一万二千", 12000), ("一〇二", 102), ("两百", 200), ("百", 0), ("一百十二", 102), ("十二万", 120000), ("万十二", 12), ("x", None), ("", None)])
def test_numerals(spark, text, value):
    assert spark.createDataFrame([(text,)], "t string").select(parse_numeral(F.col("t"))).first()[0] == value


def test_scalars(spark):
    row = spark.createDataFrame([("aaa", "aa", "第一。第二！", "张三今年三十岁了", "张三")], "a string, b string, s string, g string, n string").select(
        occurrences(F.col("a"), F.col("b")), occurrences(F.col("a"), F.col("b"), overlapping=False), sentences(F.col("s")), extract_age(F.col("g"), F.col("n")), backoff_ms(F.lit(100), F.lit(4)), align(F.col("b"), F.col("a"))["status"], hash_of(F.col("a"), F.col("b"), size=8), join_separator(F.lit("文"), F.lit("abc")), join_separator(F.lit("文"), F.lit("字"))
    ).first()
    import hashlib

    assert tuple(row) == (2, 1, ["第一。", "第二！"], 30, 800, "UNIQUE", hashlib.sha256(b"aaa|aa").hexdigest()[:8], " ", "")


def test_profiles_agree(spark):
    rng = random.Random(1)
    rows = lines.physical_lines(doc(spark, *("\n".join("x" * rng.choice([0, 0, 3, 20, 21, 40]) + rng.choice([".", "", ":"]) for _ in range(30)) for _ in range(6))), spans=False)
    a = {r.doc_id: r.asDict() for r in layout.profile(rows, ["doc_id"]).collect()}
    b = {r.doc_id: r.asDict() for r in layout.profile_simple(rows, ["doc_id"]).collect()}
    for k in a:
        for c in layout.PROFILE:
            assert a[k][c] == pytest.approx(b[k][c]), c


def plain_depths(texts, lex):
    opening, closing, stack, out = {a for a, _ in lex.quotes}, {b for _, b in lex.quotes}, [], []
    for t in texts:
        before = len(stack)
        for c in t:
            if c in opening:
                stack.pop() if stack and stack[-1] == c else stack.append(c)
            elif c in closing and stack:
                stack.pop()
        out.append((before, len(stack)))
    return out


def test_quote_depths(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("“”「」a ") for _ in range(6)) + "x" for _ in range(40)]
    rows = lines.physical_lines(doc(spark, "\n".join(texts)), spans=False)
    got = boundaries.quote_depths(rows, lex=CHINESE).orderBy("line_no").collect()
    assert [(r.depth_before, r.depth_after) for r in got] == plain_depths(texts, CHINESE)


def test_cross_line_quotes(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("“”ab") for _ in range(4)) + "x" for _ in range(60)]
    depth, inside = 0, 0
    for t in texts:
        inside += depth > 0
        for c in t:
            depth = depth + 1 if c == "“" else max(0, depth - 1) if c == "”" else depth
    got = layout.cross_line_quotes(lines.physical_lines(doc(spark, "\n".join(texts)), spans=False), ["doc_id"], CHINESE).first()
    assert got.quote_cross == pytest.approx(inside / 60)


def plain_regions(spark, rows, window):
    """Windows one after another, their classes by the plain profile."""
    parts, keyed = {}, []
    for r in rows.collect():
        parts.setdefault((r.doc_id, r.start_line), []).append(r)
    spans = {}
    for chapter, part in parts.items():
        first = min(r.line_no for r in part)
        for r in part:
            k = (r.line_no - first) // window
            keyed += [(f"{chapter}{i}", *r) for i in (-1, k)]
            spans.setdefault(chapter, {}).setdefault(k, []).append(r.line_no)
    frame = spark.createDataFrame(keyed, "key string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema))
    kinds = {r.key: (r.profile_type, round(r.confidence, 9)) for r in layout.classified(layout.profile_simple(frame, ["key"])).collect()}
    out = set()
    for chapter, windows in spans.items():
        whole, begin = kinds.get(f"{chapter}-1", (None, None)), None
        for k in sorted(windows):
            lo, hi, kind = min(windows[k]), max(windows[k]), kinds.get(f"{chapter}{k}", (None, None))
            begin = lo if begin is None else begin
            if kind[0] != whole[0] and hi > lo or k == max(windows):
                out.add((*chapter, begin, hi, *kind))
                begin = None
    return out


@pytest.mark.parametrize("window", [1, 3, 5, 200])
def test_layout_regions(spark, window):
    """Stretches of short, blank and ended lines, in chapters of which the first has no number."""
    rng = random.Random(window)
    stretch = lambda: rng.choice([lambda: "", lambda: "x" * rng.randint(1, 5), lambda: "y" * rng.randint(20, 60) + ".", lambda: "a:" + "z" * 9, lambda: "w" * 40])
    texts = ["\n".join(f() for f in (stretch() for _ in range(12)) for _ in range(rng.randint(1, 9))) for _ in range(8)]
    rows = lines.physical_lines(doc(spark, *texts, "\n\n\n", "x", ""), spans=False)
    rows = rows.withColumn("start_line", F.when(F.col("line_no") > 7, F.floor(F.col("line_no") / 20) * 20).cast("int"))
    got = layout.layout_regions(rows, window=window).collect()
    want = plain_regions(spark, rows, window)
    assert len(got) == len(want) and {(*tuple(r)[:-1], r.confidence and round(r.confidence, 9)) for r in got} == want


def test_layout_regions_read_and_shuffle_lines_once(spark):
    rows = lines.physical_lines(doc(spark, "a\nb\n"), spans=False).withColumn("start_line", F.col("line_no") * 0)
    plan = layout.layout_regions(rows, window=5)._jdf.queryExecution().executedPlan().toString()
    assert (plan.count("posexplode("), plan.count("Exchange "), plan.count("InPandas")) == (1, 1, 0)


def test_poetry_and_runs(spark):
    text = "床前明月光\n疑是地上霜\n举头望明月\n\n张三：你好\n李四：再见\n1. 甲\n2. 乙\n张三 20:31\n收尾的一句话。"
    rows = lines.physical_lines(doc(spark, text), spans=False)
    assert {(r.kind, r.from_line, r.to_line) for r in blocks.block_runs(rows, lex=CHINESE).collect()} == {("SCRIPT", 5, 6), ("LIST", 7, 8), ("MESSAGE_LOG", 9, 9)}
    runs = {(r.from_line, r.to_line) for r in blocks.poetry_runs(rows, lex=CHINESE).collect()}
    assert any(a == 1 for a, _ in runs)


def test_chapters_volumes_and_contents(spark):
    toc = [f"第{i}章 目录{i}" for i in range(1, 10)]
    body = ["第一卷 起"] + [x for i in range(1, 10) for x in (f"第{i}章 标题{i}", *["正文内容在这里。"] * 12)]
    rows = lines.physical_lines(doc(spark, "\n".join(toc + ["前言。"] * 3 + body)))
    pack = [(-1, True, "std", r"^第\s{0,4}[\d一二三四五六七八九十]{1,8}\s{0,4}(?:章|卷).{0,40}$", "", 0), (-8, True, "p", r"^\d{1,3}[、.]", "", 1), (-100, True, "empty", "", "", 2)]
    rules = chapters.typed_rules(spark.createDataFrame(pack, "id int, enable boolean, name string, rule string, example string, serialNumber int"))
    groups = chapters.winners(chapters.match_rules(rows, rules))
    totals = rows.groupBy("doc_id").agg(F.max("line_no").alias("n_lines"))
    blocks_ = chapters.toc_blocks(groups, totals)
    assert [(r.from_line, r.to_line, r.n_entries) for r in blocks_.collect()] == [(1, 9, 9)]
    vols = chapters.volumes(groups)
    assert [(r.volume_index, r.serial, r.start_line) for r in vols.collect()] == [(1, 1, 13)]
    got = chapters.resolve(groups, vols, chapters.style_profile(groups), blocks_, totals).orderBy("anchor_line").collect()
    assert [r.state for r in got] == ["TOC_ENTRY"] * 9 + ["REJECTED"] + ["CONFIRMED"] * 9
    assert [r.chapter_index for r in got if r.state == "CONFIRMED"] == list(range(1, 10)) and got[-1].content_end == len(toc) + 3 + len(body)
    frame = chapters.resolve(groups, vols, chapters.style_profile(groups), blocks_, totals).join(totals, "doc_id")
    view = chapters.canonical(frame, "n_lines").withColumn("chapter_id", F.col("anchor_line")).drop("violations")
    assert view.agg(F.max("ordinal")).first()[0] == 8 and chapters.view_violations(view).count() == 0
    over = spark.createDataFrame([(0, got[10].anchor_line, "CHANGE_TITLE", "新", 1), (0, got[10].anchor_line, "CHANGE_TITLE", "更新", 2), (0, got[11].anchor_line, "REMOVE_CHAPTER", None, 3), (0, 500, "ADD_CHAPTER", "", 4)], "doc_id long, target_line int, type string, value string, seq int")
    after = {r.anchor_line: r for r in chapters.apply_overrides(frame.drop("n_lines"), over).collect()}
    assert after[got[10].anchor_line].title == "更新" and got[11].anchor_line not in after and after[500].state == "CONFIRMED"
    linted = {r.rule_id: r.reasons for r in chapters.lint_rules(rules).collect()}
    assert linted["rule--100"] == ["EMPTY_REGEX"] and linted["rule--8"] == []


def test_segments_and_speakers(spark):
    quotes = CHINESE.quotes
    text = "张三说：“你好。”他心里暗自想：“不妙。”“走吧。”李四答道。"
    rows = doc(spark, text, "没有引号。", "“外「内」层”").withColumn("idx", F.lit(0))
    got = segments.explode_segments(rows, ["doc_id"], "idx", quotes).orderBy("doc_id", "segment_index").collect()
    assert [(r.type, r.text) for r in got if r.doc_id == 0] == [("NARRATION", "张三说："), ("SPEECH", "“你好。”"), ("NARRATION", "他心里暗自想："), ("INNER_MONOLOGUE", "“不妙。”"), ("SPEECH", "“走吧。”"), ("NARRATION", "李四答道。")]
    assert [(r.type, r.start, r.end) for r in got if r.doc_id == 1] == [("NARRATION", 0, 5)] and [r.text for r in got if r.doc_id == 2] == ["“外「内」层”"]
    cued = segments.cue_columns(segments.explode_segments(rows.where("doc_id = 0"), ["doc_id"], "idx", quotes), ["doc_id"], "idx")
    who = {r.text: (r.speaker, r.provenance) for r in segments.assign_speakers(cued, ["doc_id"], "idx").collect()}
    assert who["“你好。”"] == ("张三", "EXPLICIT_SPEECH_CUE") and who["“走吧。”"] == ("李四", "POSTPOSED_SPEECH_CUE")


def test_paragraph_join_and_links(spark):
    rows = lines.physical_lines(doc(spark, "　　他走到了门口然后\n停了下来abc\ndef。\n张三说：\n“你好”"))
    bounds = spark.createDataFrame([(0, 4, "HARD_PARAGRAPH"), (0, 5, "HARD_PARAGRAPH")], "doc_id long, next_line int, boundary_type string")
    built = paragraphs.build_paragraphs(paragraphs.sessions(rows, bounds), lex=CHINESE)
    got = built.orderBy("paragraph_index").collect()
    assert [r.text for r in got] == ["他走到了门口然后停了下来abc def。", "张三说：", "“你好”"]
    assert [(s.start, s.end, s.line_no, s.synthetic) for s in got[0].spans] == [(0, 8, 1, False), (8, 15, 2, False), (15, 16, None, True), (16, 20, 3, False)]
    assert [r.link_type for r in paragraphs.paragraph_links(built, lex=CHINESE).orderBy("paragraph_index").collect()] == ["CONTINUATION", "SPEECH_CUE"]
    spans = spark.createDataFrame([(0, 7, 2, 4)], "doc_id long, chapter_id int, start_line int, end_line int")
    assert [r.chapter_id for r in paragraphs.chapter_of(built.select("doc_id", "from_line"), spans).orderBy("from_line").collect()] == [None, 7, None]
    assert LATIN.quotes
