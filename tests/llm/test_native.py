"""Operators that run as DataFrame expressions: quality rules, chat format, URL filter, line dedup; and the classifier."""

import math
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pytest
from helpers import plain_words, sha

from folio.llm import chat_format, line_dedup, quality_classifier, quality_rules, queries, url_filter
from folio.llm.common import table


def canonical(rows):
    return sorted(map(str, rows))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.queries()[name](spark, sf)
    rel = con.sql(queries.oracle_sql()[name])
    assert sorted(rel.columns) == sorted(df.columns)
    order = [rel.columns.index(c) for c in df.columns]
    assert canonical(tuple(r) for r in df.collect()) == canonical(tuple(r[i] for i in order) for r in rel.fetchall())


def measures(text):
    text = text or ""
    w = plain_words(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    again = {x for x in windows if windows.count(x) > 1}
    lines = [x for x in text.split("\n") if plain_words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len({i + o for i, x in enumerate(windows) if x in again for o in range(3)})


def test_quality_counts(spark):
    rng = random.Random(4)
    rows = [None, "", " \n\t ", "a", "a b", "a b c", "a a a a a", "a b c a b c", "é #*$ %&|<>x\n\n \n", "x\ny\nx\n\ny\nx", "z " * 4000, "w" * 20000] + [" ".join(rng.choice("abcd") for _ in range(rng.randint(1, 40))) for _ in range(40)]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(rows)] + [(None, "a b", 5), (0, None, 5)], "doc_id long, text string, n_words int")
    got = quality_rules.apply_rules(docs).collect()
    assert len(got) == len(rows) + 2 and got[0].n_words == 5
    for r in got:
        c = r.quality_rules.counts
        assert (c.w.n_words, c.w.word_chars, c.c.n_symbols, c.l.n_dup_lines, c.w.n_repeat_words) == measures(r.text), r.text and r.text[:40]
        assert r.quality_rules.kept == (not r.quality_rules.failed)
    assert quality_rules.apply_rules(docs.limit(0)).count() == 0


def test_chat_round_trip(spark):
    nasty = ["\\### Assistant: </turn> ok", "</turn>", "<\\/turn>", "<\\\\/turn>", "\\", "<turn:user>x</turn>\n", "<<turn:", "", None, "a\nb\\n", "</turn>\n<turn:"]
    rows = [(1, i, r, t) for i, (r, t) in enumerate((r, t) for t in nasty for r in ("user", "assistant"))] + [(2, 0, "a>b%3E%25", "x"), (3, None, None, None), (3, 1, "assistant", "y"), (3, 1, "assistant", "y"), (None, 1, "user", "lost")]
    turns = spark.createDataFrame([(*r, "k") for r in rows], "conv_id long, turn long, role string, text string, tree string").drop("tree")
    made = chat_format.format_conversations(chat_format.linear_messages(turns))
    got = {r.tree: r for r in made.select("tree", chat_format.parse_turns(made.formatted).alias("t"), chat_format.masked_text(made.formatted, made.loss_mask).alias("loss")).collect()}
    assert [(x.role, x.text) for x in got[1].t] == [(r, t or "") for _, _, r, t in rows[:22]]
    assert got[1].loss == "".join(t or "" for t in nasty)
    assert [(x.role, x.text) for x in got[2].t] == [("a>b%3E%25", "x")]
    assert [(x.role, x.text) for x in got[3].t] == [("", ""), ("assistant", "y"), ("assistant", "y")] and got[3].loss == "yy"
    assert sorted(got) == [1, 2, 3]
    assert chat_format.format_conversations(chat_format.linear_messages(turns.limit(0))).count() == 0


def test_reply_trees_choose_the_best_branch(spark):
    rng = random.Random(8)
    rows = []
    for tree in range(25):
        for m in range(rng.randint(1, 30)):
            rows.append((tree, m, None if m == 0 else rng.randrange(max(0, m - 4), m), rng.choice([None, 0.0, 1.0, 2.0])))
    rows += [(99, 1, 2, 1.0), (99, 2, 1, 1.0), (98, 5, 77, 1.0)]  # a circle; a missing parent
    rows += [(97, 1, None, 1.0), (97, 2, 1, 1.0), (97, 3, 2, 1.0), (96, 1, None, 1.0), (96, 5, 4, 1.0), (95, 3, None, 1.0), (95, 2, 3, None), (94, 1, None, 1.0), (94, 2, 3, 1.0), (94, 3, 2, 1.0)]  # a path; one with a missing parent; one backward; a root beside a circle
    want = set()
    for tree in {r[0] for r in rows} - {99}:
        own = {m: (p, s or 0.0) for t, m, p, s in rows if t == tree}
        best = None
        for leaf in set(own) - {p for p, _ in own.values()}:
            path, m = [], leaf
            while m in own:
                path.append(m)
                m = own[m][0]
            key = (sum(own[x][1] for x in path) / len(path), len(path), -leaf)
            best = max(best or (key, path), (key, path))
        want |= {(tree, m) for m in best[1]}
    frame = spark.createDataFrame(rows, "tree long, msg long, parent long, score double")
    assert {tuple(r) for r in chat_format.chosen_paths(frame).collect()} == want
    made = chat_format.format_conversations(frame.selectExpr("*", "'user' AS role", "concat(tree, ' ', msg) AS text"))
    read = made.select("tree", chat_format.parse_turns(made.formatted).alias("t")).collect()
    assert {tuple(map(int, x.text.split())) for r in read for x in r.t} == want and len(read) == len({t for t, _ in want})


def test_the_query_enumerates_its_own_trees(spark, sf, monkeypatch):
    seen = []
    chosen = chat_format.chosen_paths
    monkeypatch.setattr(chat_format, "chosen_paths", lambda m: seen.append((m, out := chosen(m))) or out)
    rows = table(spark, sf, "conversations").count() + 2
    assert queries.op5_chat_format(spark, sf).count() > 0
    assert len(seen) == 1 and seen[0][0].count() == seen[0][1].count() == rows


RULES = queries.URL_RULES + [("net", "/es/", "allow"), ("exact.org", "/a", "block"), (None, "/", "block"), ("x.y", "", "block")]


def judge(url):
    url = url or ""
    host, path = "", ""
    if "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in RULES if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[3:] if fits else (None, "allow"))


@pytest.mark.parametrize("limit", [0, 1000])
def test_urls(spark, limit):
    urls = [None, "", "no scheme", "http://", "http://com", "http://com/", "http://EXAMPLE.com/en/x", "http://www.example.com/en/", "https://a.www.Example.Com/en/?q#f", "x://notexample.com/en/", "http://b.net/es/1", "http://net/fr", "http://net/fr/?", "a://exact.org/abc", "a://exact.org/b", "a://x.y", "a://q.x.y?z", "http://É.com/é", "http://u:p@h.com:80/x", "http://a..com/", "a://b\n.com/\n", "http://a/http://b.net/es/", "http://.com/"]
    pages = spark.createDataFrame([(i, u, "k") for i, u in enumerate(urls)] + [(None, "http://b.net/es/1", "k"), (4, "http://com", "k"), (4, "http://com", "k")], "page_id long, url string, rule string")
    rules = spark.createDataFrame(RULES, "rule_host string, rule_path string, verdict string")
    got = url_filter.judge_urls(pages, rules, broadcast_rules=limit).collect()
    want = [(i, *judge(u)) for i, u in enumerate(urls)] + [(None, *judge("http://b.net/es/1"))] + [(4, *judge("http://com"))] * 2
    assert canonical(tuple(r) for r in got) == canonical(want)
    assert {r.verdict for r in url_filter.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}


def test_long_hosts_take_linear_time(spark):
    host = "a." * 64_000 + "b.example.com"
    pages = spark.createDataFrame([(1, f"http://{host}/en/x"), (2, f"http://{host[:-4]}/en/x"), (3, "http://" + "." * 64_000 + "/es/")], "page_id long, url string")
    rules = spark.createDataFrame(queries.URL_RULES, "rule_host string, rule_path string, verdict string")
    began = time.time()
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(pages, rules).collect()}
    assert got == {1: ("example.com/en/", "block"), 2: (None, "allow"), 3: (None, "allow")}
    assert time.time() - began < 60


def plain_runs(rows, gram=25, run=50):
    """The module's rules, step by step."""
    seqs = {}
    for i, text in rows:
        if i is not None and text is not None:
            lines = text.split("\n")
            seqs[i] = [(x, p, len(plain_words(x))) for p, x in enumerate(lines) if plain_words(x)]

    def span(seq, i, least):
        total = 0
        for k in range(i, len(seq)):
            total += seq[k][2]
            if total >= least:
                return k + 1 - i
        return None

    return seqs, span


def test_repeated_passages_go_and_clean_lines_stay(spark):
    rng = random.Random(6)
    line = lambda n: " ".join(rng.choice("abcdefghij") + str(rng.randrange(1000)) for _ in range(n))
    passage, long_line, short = [line(20), line(17), line(22)], line(60), [line(12), line(11)]
    rows, planted = [], {}
    for i in range(60):
        own = [line(rng.randint(3, 25)) for _ in range(rng.randint(2, 8))]
        kind = i % 4
        block = {0: passage, 1: [long_line], 2: short, 3: []}[kind]
        rows.append((i, "\n".join(own[:2] + block + own[2:])))
        planted[i] = (kind, own[:2] + (block if kind == 2 or i < 2 else []) + own[2:])
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (kind, lines) in planted.items():
        assert got[i].text.split("\n") == lines, (i, kind)


def test_what_goes_is_each_long_run_that_stands_earlier(spark):
    """Against the definition, which knows neither hashes nor fingerprints."""
    rng = random.Random(9)
    pool = [" ".join(f"{rng.choice('abc')}{rng.randrange(50)}" for _ in range(rng.randint(1, 40))) for _ in range(25)]
    rows = [(i, "\n".join(rng.choice(pool + ["", " "]) if rng.random() < 0.25 else pool[(s + k) % 25] for k in range(rng.randint(0, 14)))) for i in range(120) for s in [rng.randrange(25)]]
    rows += [(200, "\n".join(["x y z w v " * 3] * 30)), (201, "\n".join(["x y z w v " * 3] * 9))]
    seqs, span = plain_runs(rows)
    got = {r.doc_id: {p for x in r.removed_runs for p in range(x.start, x.end + 1)} for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    seen = set()
    for i in sorted(seqs):
        seq, gone = seqs[i], set()
        for k in range(len(seq)):
            for m in range(span(seq, k, 50) or len(seq) + 1, len(seq) - k + 1):
                text = tuple(x for x, _, _ in seq[k : k + m])
                if text in seen:
                    gone |= {p for _, p, _ in seq[k : k + m]}
                seen.add(text)
        assert got[i] & {p for _, p, _ in seq} == gone, i


def test_all_lines_of_every_long_repeat_go(spark):
    rng = random.Random(4)
    line = lambda n: " ".join(f"{rng.choice('abcdefghij')}{rng.randrange(1000)}" for _ in range(n))
    rows, left = [], {}
    for case in range(40):  # the first document has only a piece of the passage that the next two share
        head, tail = line(30), line(30)
        for kind, lines in enumerate([[head], [head, tail], [line(3), head, tail, line(4)], [line(2), tail], [line(60), line(5)]]):
            rows.append((10 * case + kind, "\n".join(lines)))
        left[10 * case + 2] = [x for x in lines_of(rows, 10 * case + 2) if x not in (head, tail)]
        rows.append((10 * case + 5, rows[-1][1] + "\n" + line(6)))
        left[10 * case + 5] = rows[-1][1].split("\n")[2:]
    pool = [line(rng.randint(1, 40)) for _ in range(12)]
    rows += [(1000 + i, "\n".join(pool[(s + k) % 12] if rng.random() < 0.9 else rng.choice(pool) for k in range(rng.randint(0, 9)))) for i in range(150) for s in [rng.randrange(12)]]
    seqs, span = plain_runs(rows)
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: got[i].text.split("\n") for i in left} == left
    seen = set()
    for i in sorted(seqs):
        seq = seqs[i]
        gone = {p for r in got[i].removed_runs for p in range(r.start, r.end + 1)}
        for k in range(len(seq)):
            for m in range(span(seq, k, 50) or len(seq) + 1, len(seq) - k + 1):
                run = seq[k : k + m]
                text = tuple(x for x, _, _ in run)
                assert text not in seen or gone >= {p for _, p, _ in run}, (i, k, m)
                seen.add(text)


def lines_of(rows, doc):
    return next(text for i, text in rows if i == doc).split("\n")


def test_line_dedup_edges(spark):
    text = "\n".join(f"line {i} " + "w " * 30 for i in range(5))
    rows = [(None, text, 1, "k"), (1, None, 2, "k"), (2, "", 3, "k"), (3, text, 4, "k"), (3, text, 4, "k"), (4, "a\n\n" + text + "\n\nb", 5, "k"), (5, text, 6, "k"), (6, ("same " * 30 + "\n") * 6, 7, "k")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, n_chars long, removed_runs string")).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.text, r.n_chars))
    assert by[None] == [(text, 1)] and by[1] == [(None, 2)] and by[2] == [("", 3)]
    assert by[3] == [(text, 4)] * 2 and by[4] == [("a\n\n\nb", 5)] and by[5] == [("", 0)]
    assert by[6][0][0].count("same") == 30
    assert line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, n_chars long, removed_runs string").limit(0)).count() == 0


def test_line_dedup_is_whole_on_the_tables(spark, sf):
    docs = table(spark, sf, "documents")
    got = {r.doc_id: r for r in queries.op2_line_dedup(spark, sf).collect()}
    assert len(got) == docs.count()
    for r in docs.collect():
        assert got[r.doc_id].n_lines == len(r.text.split("\n"))
        if not got[r.doc_id].n_removed:
            assert got[r.doc_id].kept_sha256 == sha(r.text)


def test_classifier_ranks_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in queries.op7_quality_classifier(spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) for i, r in got.items())
    held = [(got[i].score, y) for i, y in labels.items() if got[i].held_out]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))
    right = sum((s >= 0.5) == bool(y) for s, y in held) / len(held)
    print(f"held out: area {auc:.4f}, right {right:.4f}, good kept {sum(s >= 0.5 for s in good) / len(good):.4f}, bad kept {sum(s >= 0.5 for s in bad) / len(bad):.4f}")
    assert auc > 0.97 and right > 0.95


def test_classifier_edges(spark):
    docs = spark.createDataFrame([(None, None, 1.0), (1, "", 1.0), (1, "x" * 50000, 1.0), (2, "a b", 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 0, 0), (2, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality_classifier.train(docs, labels) is None and quality_classifier.train(docs.limit(0), labels) is None
    got = quality_classifier.score(docs, None).collect()
    assert len(got) == 4 and {r.score for r in got} == {0.5}
    assert quality_classifier.score(docs.limit(0), None).count() == 0


def test_classifier_takes_one_text_for_each_id(spark):
    rng = random.Random(9)
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 != 1]
    good = lambda: " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(40))
    bad = lambda: " ".join(rng.choice("#$%&") * 9 for _ in range(40))
    rows = [(i, good() if i % 2 else bad()) for i in ids]
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")
    once = quality_classifier.train(spark.createDataFrame(rows, "doc_id long, text string"), labels, 60)
    again = quality_classifier.train(spark.createDataFrame(rows * 3 + [(None, bad())], "doc_id long, text string"), labels.union(labels), 60)
    x = [quality_classifier.features(t.encode()) for _, t in rows]
    for model in (once, again):  # repeated rows count in the sample's threshold, never twice in the sample
        assert 0.3 < model.prior < 0.7 and all((s >= 0.5) == bool(i % 2) for (i, _), s in zip(rows, model.score(np.stack(x)), strict=True))
    whole = [quality_classifier.train(spark.createDataFrame(rows * k, "doc_id long, text string"), labels, 10_000) for k in (1, 3)]
    assert whole[0].prior == whole[1].prior and np.allclose(whole[0].weights, whole[1].weights)


def plain_fit(p, u, prior, steps, rate, l2):
    """The module's rule, number by number."""
    every, k = p + u, len(p[0])
    mean = [sum(x[j] for x in every) / len(every) for j in range(k)]
    dev = [math.sqrt(sum((x[j] - mean[j]) ** 2 for x in every) / len(every)) for j in range(k)]
    norm = lambda x: [max(-8, min(8, (x[j] - mean[j]) / dev[j])) if dev[j] > 1e-4 else 0.0 for j in range(k)]
    p, u = [norm(x) for x in p], [norm(x) for x in u]
    sig = lambda t: 1 / (1 + math.exp(-t))
    w, m, v = [0.0] * (k + 1), [0.0] * (k + 1), [0.0] * (k + 1)
    for t in range(1, steps + 1):
        g = lambda x: sum(a * b for a, b in zip(w, [*x, 1], strict=True))
        taken = sum(math.log1p(math.exp(g(x))) for x in u) / len(u) - prior * sum(math.log1p(math.exp(g(x))) for x in p) / len(p)
        grad = [0.0] * (k + 1)
        for x in p:
            plus, minus = -prior * sig(-g(x)) / len(p), -prior * sig(g(x)) / len(p)
            for j, a in enumerate([*x, 1]):
                grad[j] += a * (plus + minus if taken >= 0 else -minus)
        for x in u:
            for j, a in enumerate([*x, 1]):
                grad[j] += a * sig(g(x)) / len(u) * (1 if taken >= 0 else -1)
        for j in range(k + 1):
            d = grad[j] + (l2 * w[j] if j < k else 0)
            m[j], v[j] = 0.9 * m[j] + 0.1 * d, 0.99 * v[j] + 0.01 * d * d
            w[j] -= 0.1 * rate / (1 + t / 100) * (m[j] / (1 - 0.9**t)) / (math.sqrt(v[j] / (1 - 0.99**t)) + 1e-8)
    return w, [sig(sum(a * b for a, b in zip(w, [*x, 1], strict=True))) for x in u]


@pytest.mark.parametrize("prior", [0.2, 0.9])
def test_fit_equals_plain(prior):
    rng = random.Random(2)
    p = [[rng.gauss(1, 1), rng.gauss(0, 1), 3.0] for _ in range(12)]
    u = [[rng.gauss(1 if i % 3 == 0 else -1, 1), rng.gauss(0, 1), 3.0] for i in range(25)]
    w, scores = plain_fit(p, u, prior, 60, 0.5, 1e-4)
    model = quality_classifier.fit(np.array(p), np.array(u), prior, steps=60)
    assert np.allclose(model.weights, w[:-1]) and np.isclose(model.bias, w[-1]) and np.allclose(model.score(np.array(u)), scores)


@pytest.mark.parametrize("share", [0.2, 0.5, 0.8])
def test_prior_is_estimated_without_negatives(share):
    rng = np.random.default_rng(4)
    positive = rng.normal(2, 1, (2000, 3))
    mixed = np.where(rng.random((4000, 1)) < share, rng.normal(2, 1, (4000, 3)), rng.normal(-2, 1, (4000, 3)))
    assert abs(quality_classifier.estimate_prior(positive, mixed) - share) < 0.06
