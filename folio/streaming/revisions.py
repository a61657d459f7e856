"""A revision log: what a stream appends, once each, with its state, whatever dies in between.

Each micro-batch is one version of a ``commits.Root``: its rows, and a mark that holds the batch's id and the state of the
run (rows so far, last position). Rows and state become visible by the same rename. A batch that is given again after a
crash finds its id in the last mark and is left out, so every row is in the log once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.sources.commits import Root


def last_state(root: Root) -> dict:
    """The state that the last committed batch left; a new log's is empty."""
    versions = root.versions()
    return root.told(versions[-1]) if versions else {"batch_id": -1, "rows": 0, "last": None}


def append_batch(root: Root, rows: DataFrame, batch_id: int, position: str) -> bool:
    """Appends a batch with its state, or leaves it out if it is in the log already; says which."""
    if last_state(root)["batch_id"] >= batch_id:
        return False

    def make(staged: str, _: list[int]) -> dict:
        state = last_state(root)
        rows.withColumn("batch_id", F.lit(batch_id)).write.parquet(f"{staged}/rows")
        found = root.spark.read.parquet(f"{staged}/rows").agg(F.count("*").alias("n"), F.max(position).alias("last")).first()
        return {"batch_id": batch_id, "rows": state["rows"] + found.n, "last": found.last if found.last is not None else state["last"]}

    root.write(make)
    return True


def follow(stream: DataFrame, path: str, position: str, checkpoint: str):
    """Runs the stream to its present end into the log at ``path``; after a crash, call it again."""
    root = Root(stream.sparkSession, path)
    root.sweep()
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda rows, i: append_batch(root, rows, i, position) and None).start()


def log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows of the committed batches."""
    root = Root(spark, path)
    paths = [f"{root.folder(v)}/rows" for v in root.versions()]
    return spark.read.schema(f"{schema}, batch_id int").parquet(*paths) if paths else spark.createDataFrame([], f"{schema}, batch_id int")


def revision(spark: SparkSession, path: str, schema: str, upto: int) -> DataFrame:
    """The log as it was after batch ``upto``."""
    return log(spark, path, schema).where(F.col("batch_id") <= upto)
