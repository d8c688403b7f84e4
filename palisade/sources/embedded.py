"""Python data sources over files of embedded databases, read in key ranges where the file allows it."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ROWS = 250_000  # rows of a partition, about


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def sqlite_type(declared: str) -> T.DataType:
    """By SQLite's affinity rules."""
    d = declared.upper()
    if "INT" in d:
        return T.LongType()
    if any(x in d for x in ("CHAR", "CLOB", "TEXT")):
        return T.StringType()
    if "BLOB" in d:
        return T.BinaryType()
    return T.DoubleType() if any(x in d for x in ("REAL", "FLOA", "DOUB", "NUM", "DEC")) else T.StringType()


class Range(InputPartition):
    def __init__(self, lo: int | None, hi: int | None):
        super().__init__((lo, hi))
        self.lo, self.hi = lo, hi


class SqliteDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "palisade_sqlite"

    def _connect(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True)

    def schema(self) -> T.StructType:
        with self._connect() as c:
            rows = c.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
        return T.StructType([T.StructField(r[1], sqlite_type(r[2] or ""), True) for r in rows])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return SqliteReader(self.options["path"], self.options["table"], schema)


class SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str, schema: T.StructType):
        self.path, self.table, self.kinds = path, table, [f.dataType for f in schema.fields]

    def partitions(self) -> list[Range]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as c:
            try:
                lo, hi = c.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
            except sqlite3.OperationalError:  # a view or a table without rowid
                return [Range(None, None)]
        if lo is None:
            return [Range(None, None)]
        return [Range(a, min(hi, a + ROWS - 1)) for a in range(lo, hi + 1, ROWS)]

    def read(self, partition: Range) -> Iterator[tuple]:
        where = "" if partition.lo is None else f" WHERE rowid BETWEEN {partition.lo} AND {partition.hi}"
        convert = {T.LongType: int, T.StringType: lambda v: v if isinstance(v, str) else str(v), T.DoubleType: float, T.BinaryType: lambda v: v if isinstance(v, bytes) else str(v).encode()}
        fs = [convert[type(k)] for k in self.kinds]
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as c:
            for row in c.execute(f"SELECT * FROM {_quoted(self.table)}{where}"):
                yield tuple(None if v is None else f(v) for f, v in zip(fs, row, strict=True))


class DuckDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "palisade_duckdb"

    def _sql(self) -> str:
        return f"SELECT * FROM {_quoted(self.options['schema'])}.{_quoted(self.options['table'])}"

    def schema(self) -> T.StructType:
        import duckdb
        from pyspark.sql.pandas.types import from_arrow_schema

        with duckdb.connect(self.options["path"], read_only=True) as c:
            return from_arrow_schema(c.execute(self._sql() + " LIMIT 0").to_arrow_table().schema)

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return DuckReader(self.options["path"], self._sql())


class DuckReader(DataSourceReader):
    def __init__(self, path: str, sql: str):
        self.path, self.sql = path, sql

    def read(self, partition: InputPartition) -> Iterator:
        import duckdb

        with duckdb.connect(self.path, read_only=True) as c:
            yield from c.execute(self.sql).to_arrow_reader(10_000)
