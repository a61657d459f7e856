"""A data source over SQLite files: scans by ranges of row ids, filters in the database, files opened for reading only.

    spark.dataSource.register(SqliteSource)
    spark.read.format("sqlite_file").option("path", p).option("table", "books").option("ranges", 8).load()

Each range of row ids is one partition and opens the file by itself, so the file must be where executors see it. Equality,
comparison and null filters on columns of plain names become the statement's conditions if
``spark.sql.python.filterPushdown.enabled`` is on; all others stay with Spark.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterable, Iterator
from contextlib import closing

from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual

#: By the affinity of a declared type.
KINDS = (("INT", T.LongType()), ("CHAR", T.StringType()), ("CLOB", T.StringType()), ("TEXT", T.StringType()), ("BLOB", T.BinaryType()), ("REAL", T.DoubleType()), ("FLOA", T.DoubleType()), ("DOUB", T.DoubleType()))
SIGNS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def connect(path: str) -> sqlite3.Connection:
    """Opens the file for reading only; nothing can be written or made."""
    return sqlite3.connect(f"file:{path.removeprefix('file:')}?mode=ro", uri=True)


def named(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class Range(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        self.first, self.last = first, last


class SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str, ranges: int, columns: list[str]) -> None:
        self.path, self.table, self.ranges, self.columns = path, table, ranges, columns
        self.where: list[str] = []
        self.values: list = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes what SQLite decides as Spark does; yields the rest."""
        for f in filters:
            name = named(f.attribute[0]) if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            plain = lambda v: isinstance(v, int | str) and not isinstance(v, bool)
            if name and type(f) in SIGNS and plain(f.value):
                self.where.append(f"{name} {SIGNS[type(f)]} ?")
                self.values.append(f.value)
            elif name and isinstance(f, In) and f.value and len(f.value) <= 500 and all(map(plain, f.value)):
                self.where.append(f"{name} IN ({', '.join('?' * len(f.value))})")
                self.values += list(f.value)
            elif name and isinstance(f, IsNull | IsNotNull):
                self.where.append(f"{name} IS {'NOT ' * isinstance(f, IsNotNull)}NULL")
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        with closing(connect(self.path)) as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {named(self.table)}").fetchone()
        if low is None:
            return [Range(0, -1)]
        step = max(1, -(-(high - low + 1) // self.ranges))
        return [Range(a, min(high, a + step - 1)) for a in range(low, high + 1, step)]

    def read(self, partition: Range) -> Iterator[tuple]:
        conditions = " AND ".join(["rowid BETWEEN ? AND ?", *self.where])
        with closing(connect(self.path)) as db:
            yield from db.execute(f"SELECT {', '.join(map(named, self.columns))} FROM {named(self.table)} WHERE {conditions}", [partition.first, partition.last, *self.values])


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_file"

    def schema(self) -> T.StructType:
        with closing(connect(self.options["path"])) as db:
            rows = db.execute(f"PRAGMA table_info({named(self.options['table'])})").fetchall()
        if not rows:
            raise ValueError(f"no table {self.options['table']}")
        return T.StructType([T.StructField(name, next((k for part, k in KINDS if part in (kind or "").upper()), T.StringType())) for _, name, kind, *_ in rows])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return SqliteReader(self.options["path"], self.options["table"], int(self.options.get("ranges", "8")), schema.names)


def probe(path: str) -> dict[str, int]:
    """Rows of every table of the file, which is only read."""
    with closing(connect(path)) as db:
        tables = [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name")]
        return {t: db.execute(f"SELECT count(*) FROM {named(t)}").fetchone()[0] for t in tables}
