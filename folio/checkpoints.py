"""Cutting long lineages: frames written to the shared checkpoint folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Where none is named, a session whose tasks run in the driver's own process takes a local folder; any other raises, as its executors
    could not read one another's files.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc._jsc.sc().isLocal():
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        sc.setCheckpointDir(named or "/tmp/checkpoints/folio")
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared checkpoint folder and reads it back: a short plan that outlives executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()
