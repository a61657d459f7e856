"""Every registered query of the engine against its SQL, on the smallest tables."""

import decimal

import duckdb
import pytest

from folio.plans import base, datasets, holdings, records, samples, speech, storage, structure, tables  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    return repr(round(float(v), 9)) if isinstance(v, float | decimal.Decimal) else str(v)


@pytest.mark.parametrize("name", sorted(base.SQL))
def test_equals_sql(spark, sf, con, name):
    df = base.QUERIES[name](spark, sf)
    rel = con.sql(base.SQL[name])
    assert sorted(rel.columns) == sorted(df.columns)
    order = [rel.columns.index(c) for c in df.columns]
    want = sorted(tuple(plain(r[i]) for i in order) for r in rel.fetchall())
    assert sorted(tuple(map(plain, r)) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(base.QUERIES) - set(base.SQL)))
def test_runs(spark, sf, name):
    assert base.QUERIES[name](spark, sf).count() > 0


def test_every_line_is_read_by_its_offsets(spark, sf):
    key = lambda name: sorted((r.doc_id, r.line_no, r.line_sha) for r in base.QUERIES[name](spark, sf).collect())
    assert key("lazy_line_read_all") == key("doc_lines") == key("lazy_line_read")


def test_every_token_has_its_postings(spark, sf):
    rows = {r.token: (r.n_docs, r.n_places) for r in base.QUERIES["full_text_index_all"](spark, sf).collect()}
    one = {r.token: (r.n_docs, r.n_places) for r in base.QUERIES["full_text_index"](spark, sf).collect()}
    assert one.items() < rows.items()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(base.QUERIES) <= set(entry.queries())
