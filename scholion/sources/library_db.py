"""SQLite databases as tables, read in ranges of row ids."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_KINDS = {"INTEGER": "long", "INT": "long", "REAL": "double", "TEXT": "string", "BLOB": "binary", "": "string"}


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class _Range(InputPartition):
    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


class _Reader(DataSourceReader):
    def __init__(self, path: str, table: str, columns: list[str], parts: int):
        self.path, self.table, self.columns, self.parts = path, table, columns, parts

    def partitions(self) -> list[_Range]:
        with _open(self.path) as db:
            lo, hi = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
        if lo is None:
            return []
        step = max(1, -(-(hi - lo + 1) // self.parts))
        return [_Range(s, min(s + step, hi + 1)) for s in range(lo, hi + 1, step)]

    def read(self, partition: _Range | None) -> Iterator[tuple]:
        if partition is None:  # an empty table has no partition
            return
        names = ", ".join(map(_quoted, self.columns))
        with _open(self.path) as db:
            yield from db.execute(f"SELECT {names} FROM {_quoted(self.table)} WHERE rowid >= ? AND rowid < ?", (partition.lo, partition.hi))


class SqliteTable(DataSource):
    """``spark.read.format("sqlite_table").option("table", name).load(path)``; the file lies where all executors see it."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def _columns(self) -> list[tuple[str, str]]:
        with _open(self.options["path"]) as db:
            found = db.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
        if not found:
            raise ValueError(f"no table {self.options['table']}")
        return [(r[1], _KINDS.get(r[2].upper().split("(")[0], "string")) for r in found]

    def schema(self) -> str:
        return ", ".join(f"`{n}` {k}" for n, k in self._columns())

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options["table"], [f.name for f in schema.fields], int(self.options.get("partitions", 8)))


def read_sqlite(spark: SparkSession, path: str, table: str, partitions: int = 8) -> DataFrame:
    spark.dataSource.register(SqliteTable)
    return spark.read.format("sqlite_table").option("table", table).option("partitions", partitions).load(path)
