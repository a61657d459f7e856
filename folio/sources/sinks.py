"""Sinks: stage tables keyed by revision, atomic partition replacement, JSON lines, split exports with a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.checkpoints import cut
from folio.functions.text import hash_of


def surrogate_key(df: DataFrame, name: str, *natural: str) -> DataFrame:
    """A key made of the natural key, so a repeated write gives the same one."""
    return df.withColumn(name, F.xxhash64(*natural))


def dense_keys(df: DataFrame, name: str, *natural: str) -> DataFrame:
    """The distinct natural keys, numbered from 1 without gaps in their order; nulls are keys, too.

    Keys are sorted into ranges, each range is numbered in its own task, and the counts of the ranges before it are added: only
    one count for each range comes to the driver. No two keys share a number, as no two rows share a range and a place in it.
    """
    part, row = "__part", "__row"
    ranged = df.select(*natural).distinct().repartitionByRange(*natural).sortWithinPartitions(*natural)
    placed = cut(ranged.withColumns({part: F.spark_partition_id(), row: F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}))
    sums, before = [], 0
    for r in placed.groupBy(part).count().orderBy(part).collect():
        sums.append((r[part], before))
        before += r["count"]
    offsets = df.sparkSession.createDataFrame(sums, f"{part} int, __before long")
    return placed.join(F.broadcast(offsets), part).select(*natural, (F.col("__before") + F.col(row) + 1).alias(name))


def with_dense_key(df: DataFrame, name: str, *natural: str) -> DataFrame:
    """``df`` with the number of its natural key among all of its own."""
    keys = dense_keys(df, name, *natural).select(*(F.col(c).alias(f"__{c}") for c in natural), name)
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in natural]
    return df.join(keys, on).select(*df.columns, name)


def key_faults(keys: DataFrame, name: str) -> DataFrame:
    """One row: keys, and how many numbers are shared, missing below the largest, or below 1; all 0 proves that keys are dense and unique."""
    per = keys.groupBy(name).agg(F.count("*").alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_keys"), F.count_if(F.col("n") > 1).alias("shared"), F.coalesce(F.max(name) - F.count("*"), F.lit(0)).alias("missing"), F.count_if(F.col(name) < 1).alias("below"))


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_stage(stages: dict[str, DataFrame], root: str, revision: str) -> None:
    """One folder for each table of a stage, partitioned by revision; only that revision is replaced."""
    for name, df in stages.items():
        df.withColumn("revision_id", F.lit(revision)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("revision_id").parquet(f"{root}/{name}")


def replace_partition(df: DataFrame, path: str, *keys: str) -> None:
    """Replaces just the partitions that ``df`` holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def write_json_lines(df: DataFrame, path: str, *keys: str) -> None:
    w = df.write.mode("append")
    (w.partitionBy(*keys) if keys else w).json(path)


def export_splits(samples: DataFrame, path: str) -> DataFrame:
    """Samples as JSON lines in a folder for each split; returns the counts by split and task."""
    samples.write.mode("overwrite").partitionBy("split").json(path)
    return samples.groupBy("split", "task").agg(F.count("*").alias("n"))


def manifest(samples: DataFrame, id_col: str, keys: list[str]) -> DataFrame:
    """One row for each key: rows, and a digest of its sorted ids' digests that doesn't depend on order."""
    part = F.conv(F.left(F.sha2(F.col(id_col).cast("string").cast("binary"), 256), F.lit(12)), 16, 10).cast("decimal(38,0)")
    return samples.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.sum(part).cast("string").alias("digest"))


def export_traces(rows: DataFrame, kinds: list[str], private: bool = False) -> DataFrame:
    """Trace rows of known kinds with a deterministic id; texts are left out unless ``private``."""
    kept = rows.where(F.col("kind").isin(*kinds)).withColumn("trace_id", hash_of(F.col("kind"), F.col("source_id"), F.col("seq"), size=16))
    return kept if private else kept.withColumn("text", F.lit(None).cast("string"))


def migrate_columns(df: DataFrame, added: dict[str, str]) -> DataFrame:
    """Additive migration: new columns are null, old ones stay."""
    return df.select("*", *(F.lit(None).cast(kind).alias(c) for c, kind in added.items() if c not in df.columns))


def assemble_results(spark: SparkSession, paths: dict[str, str], metrics: list[str]) -> DataFrame:
    """A row for each run's metric file; a missing file gives nulls."""
    schema = ", ".join(f"{m} double" for m in metrics)
    jvm = spark.sparkContext._jvm
    rows = None
    for run, path in paths.items():
        p = jvm.org.apache.hadoop.fs.Path(path)
        there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
        df = spark.read.schema(schema).option("multiLine", "true").json(path) if there else spark.range(1).select(*(F.lit(None).cast("double").alias(m) for m in metrics))
        df = df.select(F.lit(run).alias("run"), *metrics)
        rows = df if rows is None else rows.unionByName(df)
    return rows
