"""The corpus pipeline, stage by stage and as a whole, on a small corpus with planted cases."""

import gc
import os
import random
import weakref
import zlib

import pytest
from helpers import alnum_words, near_duplicates as plain_groups, plain_words, sha

from pyspark.sql import functions as F

import corpus_pipeline
from folio.llm import byte_bpe, components, decontaminate, ngram_join, quality_classifier, queries
from folio.llm.common import checkpoint_dir, table

STAGES = dict(corpus_pipeline.STAGES)
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_are_the_dealt_ones():
    assert list(STAGES) == ["quality_classifier", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "byte_bpe"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder with documents, labels and benchmark: prose and junk, exact and near copies, repeated passages, benchmark text, nulls and repeated rows."""
    rng = random.Random(12)
    words = [f"{a}{b}" for a in "ba ce di fo gu ha je ki lo mu".split() for b in "ran sel tin vor wup xan".split()]
    prose = lambda n, line=12: "\n".join(" ".join(rng.choice(words) for _ in range(line)) for _ in range(n // line))
    junk = lambda: " ".join(rng.choice("$#@%&") * 8 + str(rng.randrange(10**6)) for _ in range(60))
    items = [(i, " ".join(rng.choice(words) for _ in range(25))) for i in range(3)]
    passage = prose(72)
    rows = [(i, prose(120)) for i in range(160)]
    rows += [(200 + i, junk()) for i in range(80)]
    rows += [(300 + i, rows[i][1]) for i in range(5)]  # exact copies
    near = []
    for i in range(5, 10):
        w = rows[i][1].split(" ")
        w[30] = "changed"
        near.append((300 + i, " ".join(w)))
    rows += near
    rows += [(400 + i, f"{prose(48)}\n{passage}\n{prose(48)}") for i in range(4)]
    rows += [(500, f"{prose(96)}\n{items[0][1]}\n{prose(96)}"), (501, f"{items[1][1]} {items[2][1]} short end"), (502, None), (503, ""), (None, prose(60)), (504, prose(60)), (504, prose(60))]
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.createDataFrame([(i, t, "xx", "web", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(not 200 <= i < 300), 0) for i, _ in rows if i is not None and i < 300], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_classifier_keeps_prose_alone(spark, corpus):
    docs = table(spark, corpus, "documents")
    kept = STAGES["quality_classifier"](spark, docs, corpus)
    assert kept.columns == COLUMNS
    ids = {r.doc_id for r in kept.collect()}
    assert not ids & set(range(200, 280)) and ids >= {*range(160), *range(300, 310), *range(400, 404), 500, 504, None}
    assert any(zlib.crc32(str(i).encode()) % 3 == 1 for i in range(200, 280))


def test_line_dedup_deletes_later_repeats(spark, corpus):
    docs = table(spark, corpus, "documents")
    done = STAGES["line_dedup"](spark, docs, corpus)
    assert done.columns == COLUMNS and done.count() == docs.count()
    before, after = dict(rows_of(docs.where("doc_id < 500"))), dict(rows_of(done.where("doc_id < 500")))
    for i in range(160):
        assert after[i] == before[i]
    assert all(after[300 + i] == "" for i in range(5))
    lines = before[400].split("\n")
    assert after[400] == before[400] and all(after[400 + i] == "\n".join(x for x in before[400 + i].split("\n") if x not in lines) for i in range(1, 4))
    assert all(r.n_chars == len(r.text) for r in done.where("doc_id < 500").collect())


def test_join_keeps_one_of_each_group(spark, corpus):
    docs = table(spark, corpus, "documents")
    kept = STAGES["ngram_jaccard_join"](spark, docs, corpus)
    assert kept.columns == COLUMNS
    rows = [(r.doc_id, r.text) for r in docs.where("doc_id is not null and doc_id <> 504").collect()]
    least = {i for i, (_, c) in plain_groups(rows).items() if i == c}
    assert {r.doc_id for r in kept.collect()} == least | {504, None}
    assert kept.where("doc_id = 504").count() == 1


def test_decontamination_cuts_spans_and_drops_copies(spark, corpus):
    docs = table(spark, corpus, "documents")
    done = STAGES["benchmark_decontamination"](spark, docs, corpus)
    assert done.columns == COLUMNS
    before, after = dict(rows_of(docs)), dict(rows_of(done))
    item = next(r.text for r in table(spark, corpus, "benchmark").collect() if r.item_id == 0)
    assert 501 not in after and after[500] == before[500].replace(item, "")
    assert {k: v for k, v in after.items() if k not in (500, 501)} == {k: v for k, v in before.items() if k not in (500, 501)}
    assert alnum_words(after[500]) and after[502] is None


def test_whole_pipeline(spark, corpus):
    docs = table(spark, corpus, "documents")
    want = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        want = spark.createDataFrame(stage(spark, want, corpus).collect(), docs.schema)
    texts = rows_of(want)
    got = corpus_pipeline.run(spark, corpus).collect()
    assert sorted(((r.doc_id, r.decoded_sha256) for r in got), key=str) == sorted(((i, sha(t or "")) for i, t in texts), key=str)
    ids = {r.doc_id for r in got}
    assert ids >= set(range(160)) | {400, 500, 504} and not ids & {*range(200, 280), 501}
    assert sum(len(plain_words(t)) for _, t in texts) > 160 * 110


def test_text_that_is_no_utf8_passes_every_stage(spark, corpus):
    raw = "X'" + ("a\u00e9 plain words of a text " * 30).encode().hex() + "ff62'"
    odd = table(spark, corpus, "documents").where("doc_id < 3").withColumn("text", F.expr(f"cast({raw} AS string)")).withColumn("doc_id", F.col("doc_id") + 9000)
    docs = table(spark, corpus, "documents").unionByName(odd)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, corpus)
        assert out.count() > 0
        docs = out if "text" in out.columns else docs
    kept = table(spark, corpus, "benchmark").selectExpr("text").limit(1).crossJoin(odd.select("doc_id", "lang", "source", "n_chars").limit(1))
    mixed = kept.withColumn("text", F.concat(F.expr(f"cast({raw} AS string)"), F.lit(" "), F.col("text"))).select(*COLUMNS)
    done = STAGES["benchmark_decontamination"](spark, mixed, corpus).select(F.col("text").cast("binary").alias("t")).collect()
    assert len(done) == 1 and bytes(done[0].t).endswith(b"\xffb ")


def test_empty_tables(spark, corpus, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        table(spark, corpus, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_intermediate_tables_go(spark, corpus):
    root = checkpoint_dir(spark).removeprefix("file:")
    corpus_pipeline.run(spark, corpus)
    import glob
    import os

    newest = max(glob.glob(f"{root}/pipeline-*"), key=os.path.getmtime)
    assert os.listdir(newest) == ["byte_bpe"]


def test_query_is_registered():
    assert corpus_pipeline.queries()["pipeline"] is corpus_pipeline.run and "pipeline" not in queries.queries()


def test_a_worker_holds_no_table_of_another_stage():
    """Python workers outlive their stages, so what one leaves there adds to the memory of the next ones."""
    bpe = weakref.ref(byte_bpe.loaded(*queries.bpe_files()))
    assert bpe() is byte_bpe.loaded(*queries.bpe_files())
    matcher = weakref.ref(decontaminate._matcher("one", [(1, [b"word"] * 12)], 10))
    assert matcher() is decontaminate._matcher("one", [], 10)
    gc.collect()
    assert bpe() is None
    assert list(ngram_join._chunks(iter([]))) == []
    gc.collect()
    assert matcher() is None


def test_classifier_is_fitted_in_a_task(spark, corpus, monkeypatch):
    driver, fit = os.getpid(), quality_classifier.fit

    def elsewhere(*given):
        assert os.getpid() != driver, "fitted on the driver"
        return fit(*given)

    docs, labels = table(spark, corpus, "documents"), table(spark, corpus, "labels")
    with monkeypatch.context() as m:
        m.setattr(quality_classifier, "fit", elsewhere)
        model = quality_classifier.train(docs, labels)
    assert 0 < model.prior < 1 and model.weights.shape == model.mean.shape == (256 + quality_classifier.EXTRA,)


def test_rounds_over_few_links_are_few_tasks(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7)]
    given = {"spark.sql.shuffle.partitions": "23", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in given}
    try:
        for k, v in given.items():
            spark.conf.set(k, v)
        links = spark.createDataFrame(edges, "a long, b long")
        assert components.contract(links).rdd.getNumPartitions() == 1
        found = {r.node: r.component for r in components.connected_components(links).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found == {i: 0 for i in range(41)} | {i: 100 for i in (100, 101, 102)}
