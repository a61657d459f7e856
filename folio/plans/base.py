"""Registry of named queries: a Spark plan and, where SQL says the same, DuckDB SQL for its rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, with its oracle."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


#: Lines of the documents, as DuckDB sees them.
LINES = r"""l0 AS (SELECT doc_id, regexp_split_to_array(text, '\r\n|\r|\n') AS a FROM documents),
l1 AS (SELECT doc_id, unnest(a) AS text, generate_subscripts(a, 1) AS line_no, len(a) AS n FROM l0),
lines AS (SELECT doc_id, line_no::INT AS line_no, text, length(text)::INT AS char_count, NOT regexp_matches(text, '[^\s]') AS is_blank FROM l1 WHERE NOT (line_no = n AND text = ''))"""
#: The block class of a line by the Latin lexicon; ``t`` is the trimmed text.
CLASS = r"""CASE WHEN t = '' THEN 'UNKNOWN' WHEN regexp_matches(t, '^[*\-—＝=~☆★●○◆◇▁▂▃▄]{3,}\s*$') THEN 'SEPARATOR' WHEN regexp_matches(t, '^https?://\S+$|^www\..+\.[a-z]{2,}$') THEN 'BOILERPLATE' WHEN regexp_matches(t, '^\[.*\]\s*$') THEN 'LYRICS'
 WHEN regexp_matches(t, '^【.{1,20}】\s*$') THEN 'SCREEN_TEXT' WHEN regexp_matches(t, '^.{1,16}\s+\d{1,2}:\d{2}\s*$') THEN 'MESSAGE_LOG' WHEN regexp_matches(t, '^\s*\d{1,3}[.、)）]\s*\S+.*$') THEN 'LIST' WHEN regexp_matches(t, '^[^,.!?;:]{1,10}:\s*[^\n]{0,40}$') THEN 'SCRIPT'
 WHEN starts_with(t, 'Dear') AND contains(t, ':') THEN 'LETTER' ELSE 'PROSE' END"""
RUN_KIND = r"""CASE WHEN regexp_matches(t, '^.{1,16}\s+\d{1,2}:\d{2}\s*$') THEN 'MESSAGE_LOG' WHEN regexp_matches(t, '^[^,.!?;:]{1,10}:\s*[^\n]{0,40}$') THEN 'SCRIPT' WHEN regexp_matches(t, '^\s*\d{1,3}[.、)）]\s*\S+.*$') THEN 'LIST' END"""
