"""The corpus pipeline: quality classifier, line dedup, n-gram Jaccard join, benchmark decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame; all but the
last return the columns of ``documents``. SQL can't state learned or hashed stages, so ``ORACLE_SQL`` is None.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from folio.llm import byte_bpe, decontaminate, line_dedup, ngram_join, quality_classifier
from folio.llm.common import checkpoint_dir, drop_folder, table
from folio.llm.queries import bpe_files

ORACLE_SQL: str | None = None


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality_classifier.keep_good(docs, quality_classifier.train(docs, table(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines go from the texts; a document that loses every line keeps its row."""
    return line_dedup.dedup_lines(docs).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return ngram_join.keep_one(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages go from the texts, and documents that are mostly benchmark go."""
    return decontaminate.remove_spans(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids."""
    return byte_bpe.encode_documents(docs, *bpe_files())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", classify),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", remove_benchmark),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written as Parquet to the shared folder and reread.

    A stage's rows are deleted once the next stage's are written; those of the last stage are what the result reads.
    """
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid4().hex}"
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if last:
            drop_folder(spark, f"{folder}/{last}")
        last = name
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
