"""Tables of an SQLite database file, read by ranges of row ids: a data source of Spark's own interface."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, LongType, StructType

#: Endings of database files.
SUFFIXES = (".db", ".sqlite", ".sqlite3")


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _open(path: str) -> sqlite3.Connection:
    """Read only: readers neither wait for one another nor leave a journal."""
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, path: str, table: str, n: int, schema: StructType):
        self.path, self.table, self.n, self.schema = path, table, n, schema

    def partitions(self) -> list[InputPartition]:
        with _open(self.path) as base:
            low, high = base.execute(f"select min(rowid), max(rowid) from {_quoted(self.table)}").fetchone()
        if low is None:
            return [_Range(1, 0)]
        step = max(1, -(-(high - low + 1) // self.n))
        return [_Range(at, min(high, at + step - 1)) for at in range(low, high + 1, step)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        """SQLite holds any kind of value in any column: numbers are made what the schema says, what isn't a number is null."""
        kinds = [{LongType: int, DoubleType: float}.get(type(f.dataType), str) for f in self.schema.fields]
        names = ", ".join(_quoted(f.name) for f in self.schema.fields)

        def made(kind: type, value):
            try:
                return None if value is None else kind(value)
            except ValueError:
                return None

        base = _open(self.path)
        try:
            for row in base.execute(f"select {names} from {_quoted(self.table)} where rowid between ? and ?", (partition.low, partition.high)):
                yield tuple(made(k, v) for k, v in zip(kinds, row, strict=True))
        finally:
            base.close()


class SqliteRows(DataSource):
    """Options: path (on a folder that all executors see), dbtable, partitions. Each partition is a range of row ids, which SQLite finds by its own tree. Without a schema it is that of the table: whole numbers, doubles and texts."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_rows"

    def schema(self) -> str:
        with _open(self.options["path"]) as base:
            columns = base.execute(f"pragma table_info({_quoted(self.options['dbtable'])})").fetchall()
        if not columns:
            raise ValueError(f"no table {self.options['dbtable']}")
        kinds = [("long" if "INT" in c[2].upper() else "double" if any(k in c[2].upper() for k in ("REAL", "FLOA", "DOUB")) else "string") for c in columns]
        return ", ".join(f"`{c[1]}` {k}" for c, k in zip(columns, kinds, strict=True))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self.options["dbtable"], int(self.options.get("partitions", "8")), schema)


def read_database(spark: SparkSession, path: str, table: str, schema: str | None = None, partitions: int = 8) -> DataFrame:
    """One table of a database file. schema: names and types of the columns wanted (long, double, string); by default all, as declared."""
    spark.dataSource.register(SqliteRows)
    reader = spark.read.format("sqlite_rows").option("path", path).option("dbtable", table).option("partitions", partitions)
    return (reader.schema(schema) if schema else reader).load()
