"""Package import: files become packages by the digest of their bytes, committed a batch at a time.

Each batch is one version of a ``commits.Root``: ``files`` (a row for each file given, with its outcome, and its bytes where
it is new) and ``manifest`` (book_id, source_name, title, sha256, bytes, batch of the new ones). A file whose id is known
with the same digest is a duplicate and one with another digest a collision; neither is stored, and the stored one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.sources.commits import Root

MANIFEST = "book_id string, source_name string, title string, sha256 string, bytes long, batch string"
OUTCOMES = "source_name string, book_id string, sha256 string, outcome string, batch string"


def _read(spark: SparkSession, root: Root, part: str, schema: str) -> DataFrame:
    paths = [f"{root.folder(v)}/{part}" for v in root.versions()]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The manifests of all committed packages."""
    return _read(spark, Root(spark, path), "manifest", MANIFEST)


def outcomes(spark: SparkSession, path: str) -> DataFrame:
    """What became of each file of each committed batch."""
    return _read(spark, Root(spark, path), "files", OUTCOMES)


def contents(spark: SparkSession, path: str) -> DataFrame:
    """book_id and bytes of all committed packages."""
    return _read(spark, Root(spark, path), "files", f"{OUTCOMES}, content binary").where("outcome = 'NEW'").select("book_id", "content")


def judged(files: DataFrame, known: DataFrame) -> DataFrame:
    """``files`` (source_name, content and, if ids are given, book_id) with sha256, book_id and outcome.

    Of several files with one id in a batch, the first by name is the one that the others are held against. Null contents
    are empty files; rows that repeat a name and content are duplicates of one another.
    """
    raw = files.withColumn("content", F.coalesce("content", F.lit(b"")))
    keyed = raw.withColumn("sha256", F.sha2("content", 256))
    keyed = keyed if "book_id" in files.columns else keyed.withColumn("book_id", F.concat(F.lit("book-"), F.left("sha256", F.lit(12))))
    met = keyed.join(known.select("book_id", F.col("sha256").alias("held")), "book_id", "left")
    w = W.partitionBy("book_id").orderBy("source_name", "sha256")
    first = F.coalesce("held", F.first("sha256").over(w))
    new = F.col("held").isNull() & (F.row_number().over(w) == 1)
    return met.withColumn("outcome", F.when(new, "NEW").when(first == F.col("sha256"), "DUPLICATE").otherwise("COLLISION")).drop("held")


def import_files(spark: SparkSession, files: DataFrame, path: str, batch: str) -> int:
    """Imports a batch of files and returns its version; on a conflict with another importer it is judged again."""
    root = Root(spark, path)

    def make(staged: str, versions: list[int]) -> dict:
        done = judged(files, _read(spark, root, "manifest", MANIFEST)).withColumn("batch", F.lit(batch))
        new = F.col("outcome") == "NEW"
        stem = F.regexp_replace("source_name", r"\.[^.]*$", "")
        title = F.when(F.trim(stem) == "", F.lit("untitled")).otherwise(stem)
        size = F.octet_length("content").cast("long")
        done.select("source_name", "book_id", "sha256", "outcome", "batch", title.alias("title"), size.alias("bytes"), F.when(new, F.col("content")).alias("content")).write.parquet(f"{staged}/files")
        given = spark.read.parquet(f"{staged}/files").drop("content")
        given.where(new).select("book_id", "source_name", "title", "sha256", "bytes", "batch").write.parquet(f"{staged}/manifest")
        return {"batch": batch, **{r.outcome: r["count"] for r in given.groupBy("outcome").count().collect()}}

    return root.write(make)
