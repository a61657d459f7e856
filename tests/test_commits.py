"""Commits that survive crashes: package import, the revision log, SQLite scans, record and replay."""

import hashlib
import sqlite3

import pytest
from pyspark.sql import functions as F

from folio.operators import replay
from folio.sources import packages, sqlite
from folio.sources.commits import Conflict, Root
from folio.streaming import revisions


def files(spark, rows):
    return spark.createDataFrame([(n, None if c is None else c.encode()) for n, c in rows], "source_name string, content binary")


def told(spark, path):
    return sorted((r.batch, r.source_name, r.outcome) for r in packages.outcomes(spark, path).collect())


def test_outcomes_and_contents(spark, tmp_path):
    at = str(tmp_path)
    assert packages.stored(spark, at).count() == 0
    assert packages.import_files(spark, files(spark, [("a.txt", "one"), ("b.txt", "two"), ("c.txt", "one"), (".txt", None)]), at, "1") == 0
    assert packages.import_files(spark, files(spark, [("d.txt", "two"), ("e.txt", "three")]), at, "2") == 1
    assert told(spark, at) == [("1", ".txt", "NEW"), ("1", "a.txt", "NEW"), ("1", "b.txt", "NEW"), ("1", "c.txt", "DUPLICATE"), ("2", "d.txt", "DUPLICATE"), ("2", "e.txt", "NEW")]
    named = files(spark, [("x.txt", "one"), ("y.txt", "other")]).withColumn("book_id", F.lit("book-" + hashlib.sha256(b"two").hexdigest()[:12]))
    packages.import_files(spark, named, at, "3")
    assert told(spark, at)[-2:] == [("3", "x.txt", "COLLISION"), ("3", "y.txt", "COLLISION")]
    held = {r.book_id: bytes(r.content) for r in packages.contents(spark, at).collect()}
    assert sorted(held.values()) == [b"", b"one", b"three", b"two"]
    assert {(r.title, r.bytes) for r in packages.stored(spark, at).collect()} == {("untitled", 0), ("a", 3), ("b", 3), ("e", 5)}
    assert all(i == "book-" + hashlib.sha256(c).hexdigest()[:12] for i, c in held.items())


@pytest.mark.parametrize("step", ["write", "mark", "commit"])
def test_a_crash_at_any_step_leaves_the_old_state(spark, tmp_path, monkeypatch, step):
    at = str(tmp_path)
    packages.import_files(spark, files(spark, [("a.txt", "one")]), at, "1")
    before = told(spark, at)

    def dies(*_):
        raise KeyboardInterrupt

    if step == "write":
        given = files(spark, [("b.txt", "two")]).withColumn("content", F.when(F.lit(True), F.raise_error(F.lit("gone"))).cast("binary"))
        with pytest.raises(Exception, match="gone"):
            packages.import_files(spark, given, at, "2")
    else:
        with monkeypatch.context() as m:
            m.setattr(Root, step, dies)
            with pytest.raises(KeyboardInterrupt):
                packages.import_files(spark, files(spark, [("b.txt", "two")]), at, "2")
    assert told(spark, at) == before
    assert Root(spark, at).sweep() <= 1 and Root(spark, at).sweep() == 0
    packages.import_files(spark, files(spark, [("b.txt", "two"), ("a2.txt", "one")]), at, "2")
    assert told(spark, at) == [*before, ("2", "a2.txt", "DUPLICATE"), ("2", "b.txt", "NEW")]


def test_of_two_importers_one_judges_again(spark, tmp_path, monkeypatch):
    at, commit, turns = str(tmp_path), Root.commit, []

    def late(root, staged, version):
        if not turns:  # another importer is faster
            turns.append(version)
            packages.import_files(spark, files(spark, [("first.txt", "same")]), at, "fast")
        return commit(root, staged, version)

    monkeypatch.setattr(Root, "commit", late)
    assert packages.import_files(spark, files(spark, [("second.txt", "same")]), at, "slow") == 1
    assert told(spark, at) == [("fast", "first.txt", "NEW"), ("slow", "second.txt", "DUPLICATE")]


def test_versions_are_never_overwritten(spark, tmp_path):
    root = Root(spark, str(tmp_path))
    one, two = root.stage(), root.stage()
    with pytest.raises(ValueError):
        root.commit(one, 0)
    root.mark(one, {"n": 1})
    root.mark(two, {"n": 2})
    root.commit(one, 0)
    with pytest.raises(Conflict):
        root.commit(two, 0)
    assert root.versions() == [0] and root.told(0) == {"n": 1}


def test_revision_log_has_each_row_once(spark, tmp_path, monkeypatch):
    source, path = f"{tmp_path}/in", f"{tmp_path}/log"
    schema = "id long, at long"
    put = lambda ids: spark.createDataFrame([(i, i * 10) for i in ids], schema).write.mode("append").parquet(source)
    put([1, 2, 3])
    run = lambda: revisions.follow(spark.readStream.schema(schema).parquet(source), path, "at", f"{tmp_path}/check").awaitTermination()
    run()
    put([4, 5])
    mark = Root.mark
    with monkeypatch.context() as m:  # dies with rows staged and no mark
        m.setattr(Root, "mark", lambda *_: (_ for _ in ()).throw(RuntimeError("dies")))
        with pytest.raises(Exception, match="dies"):
            run()
    assert sorted(r.id for r in revisions.log(spark, path, schema).collect()) == [1, 2, 3]
    write = Root.write
    with monkeypatch.context() as m:  # dies right after the commit, before Spark knows
        m.setattr(Root, "mark", mark)
        m.setattr(Root, "write", lambda self, make: (write(self, make), (_ for _ in ()).throw(RuntimeError("late"))))
        with pytest.raises(Exception, match="late"):
            run()
    put([6])
    run()
    rows = revisions.log(spark, path, schema)
    assert sorted(r.id for r in rows.collect()) == [1, 2, 3, 4, 5, 6]
    state = revisions.last_state(Root(spark, path))
    assert (state["rows"], state["last"]) == (6, 60)
    assert sorted(r.id for r in revisions.revision(spark, path, schema, 0).collect()) == [1, 2, 3]


@pytest.fixture
def database(tmp_path):
    path = f"{tmp_path}/books.db"
    db = sqlite3.connect(path)
    db.execute('CREATE TABLE books (id INTEGER PRIMARY KEY, title TEXT, size REAL, "odd ""name" VARCHAR(9), raw BLOB)')
    db.executemany("INSERT INTO books VALUES (?, ?, ?, ?, ?)", [(i, f"t{i % 5}" if i % 7 else None, i / 4, "x", b"\x00") for i in range(1, 101)])
    db.execute('CREATE TABLE "empty one" (a INT)')
    db.commit()
    db.close()
    return path


def test_sqlite_scan(spark, database, monkeypatch):
    spark.dataSource.register(sqlite.SqliteSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    load = lambda table, n=4: spark.read.format("sqlite_file").option("path", database).option("table", table).option("ranges", n).load()
    df = load("books")
    assert df.dtypes == [("id", "bigint"), ("title", "string"), ("size", "double"), ('odd "name', "string"), ("raw", "binary")]
    assert df.count() == 100 and df.rdd.getNumPartitions() == 4
    assert [r.n for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()] == [25] * 4
    assert sorted(r.id for r in df.where("title = 't1' AND id > 50").collect()) == [i for i in range(51, 101) if i % 5 == 1 and i % 7]
    assert df.where("title is null").count() == 14 and df.where("id in (3, 4, 400)").count() == 2
    assert "ArrowEvalPython" not in df._jdf.queryExecution().toString()
    assert load("empty one").count() == 0
    assert sqlite.probe(database) == {"books": 100, "empty one": 0}
    with pytest.raises(sqlite3.OperationalError):
        sqlite.connect(database).execute("DELETE FROM books")


def test_filters_are_the_database_s(database):
    from pyspark.sql.datasource import EqualTo, In, IsNotNull, StringContains

    reader = sqlite.SqliteReader(database, "books", 3, ["id"])
    other = StringContains(("title",), "t")
    assert list(reader.pushFilters([EqualTo(("title",), "t1"), In(("id",), (1, 6, 11)), other, IsNotNull(("title",)), EqualTo(("a", "b"), 1)])) == [other, EqualTo(("a", "b"), 1)]
    parts = reader.partitions()
    assert [(p.first, p.last) for p in parts] == [(1, 34), (35, 68), (69, 100)]
    assert [r for p in parts for r in reader.read(p)] == [(1,), (6,), (11,)]


CALLS = "run string, at long, store string, method string, a string, b int, got string"


def test_replay(spark):
    calls = [("r", 1, "s", "get", "k", 1, "one"), ("r", 2, "s", "get", "k", 1, "two"), ("r", 3, "s", "get", None, 1, "null"), ("r", 4, "s", "get", "", 1, "empty"), ("q", 1, "s", "get", "k", 1, None)]
    log = replay.record(spark.createDataFrame(calls, CALLS), ["a", "b"], "got")
    asked = [("r", 10, "s", "get", "k", 1, "one"), ("r", 11, "s", "get", "", 1, "empty"), ("r", 12, "s", "get", "k", 1, "TWO"), ("r", 13, "s", "get", "k", 1, "three"), ("r", 14, "s", "put", "k", 1, None), ("r", 15, "s", "get", None, 1, "null"), ("q", 1, "s", "get", "k", 1, None)]
    made = spark.createDataFrame(asked, CALLS)
    got = replay.replay(made, log, ["a", "b"], "got")
    assert sorted((r.run, r.at, r.result, r.outcome) for r in got.collect()) == [("q", 1, None, "HIT"), ("r", 10, "one", "HIT"), ("r", 11, "empty", "HIT"), ("r", 12, "two", "MISMATCH"), ("r", 13, None, "EXHAUSTED"), ("r", 14, None, "MISSING"), ("r", 15, "null", "HIT")]
    assert sorted(map(tuple, replay.divergences(got).collect())) == [("q", 1, 1, None, None, None, None), ("r", 6, 3, 12, "s", "get", "MISMATCH")]
    assert replay.replay(made.limit(0), log, ["a", "b"]).count() == 0
