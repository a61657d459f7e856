"""Small helpers that the corpus operators share."""

from __future__ import annotations

import gc
from collections.abc import Callable, Hashable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.checkpoints import checkpoint_dir, cut
from folio.functions.text import free_name

__all__ = ["ALNUM", "LOWER", "UPPER", "WORD", "WORD_BREAK", "ascii_lower", "checkpoint_dir", "cut", "drop_folder", "drop_held", "free_name", "held", "let", "quoted", "release", "table", "text_bytes"]

#: Words are maximal runs without space, tab, line feed, vertical tab, form feed or carriage return.
WORD = r"[^\x20\x09-\x0D]+"
WORD_BREAK = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Maps A-Z to a-z and every ASCII byte that is neither a letter nor a digit to a space.
#: Bytes from 0x80 stay: they are parts of words, as all their code points are.
ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z alone, as no locale or Unicode rule would."""
    return F.translate(c, UPPER, LOWER)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for each row, not at each use inside lambdas."""
    return F.transform(F.array(value), body)[0]


def quoted(names: list[str]) -> list[Column]:
    """Columns by their names, whatever characters these hold."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def drop_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder of intermediate tables, on whatever file system it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop shuffle files and checkpoints that no plan refers to any more; it works beside the next job."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_HELD: dict[Hashable, object] = {}


def held[T](key: Hashable, make: Callable[[], T]) -> T:
    """The table of one operator, made once for each worker process.

    Workers outlive their stages, so a process holds one table at a time: another key's goes before this one is made.
    """
    if key not in _HELD:
        drop_held()
        _HELD[key] = make()
    return _HELD[key]


def drop_held() -> None:
    """Frees the table that an earlier stage has left in this worker process; tasks that need memory and no table begin with it."""
    if _HELD:
        _HELD.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()


def text_bytes(batches: Iterator[pa.RecordBatch], id_col: str, text_col: str, rows: int = 512):
    """Yields (ids as an Arrow array, texts as a list of bytes) for a few hundred rows at a time; null texts are empty."""
    for batch in batches:
        ids, texts = batch.column(id_col), batch.column(text_col)
        for at in range(0, batch.num_rows, rows):
            yield ids.slice(at, rows), [b"" if x is None else x for x in texts.slice(at, rows).to_pylist()]
