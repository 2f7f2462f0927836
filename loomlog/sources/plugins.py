"""Sources and functions that Spark knows by name: SQLite tables as a data source, a session's readings as a table function."""

from __future__ import annotations

import sqlite3
from collections.abc import Callable, Iterable, Iterator
from contextlib import closing

from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

#: Rows of a partition.
ROWS = 50_000
_SIGNS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
_KINDS = {"INTEGER": LongType(), "INT": LongType(), "BIGINT": LongType(), "REAL": DoubleType(), "DOUBLE": DoubleType()}


def _opened(path: str) -> closing[sqlite3.Connection]:
    return closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True))


def _name(column: str) -> str:
    return '"' + column.replace('"', '""') + '"'


class SqliteSource(DataSource):
    """``spark.read.format("sqlite")``: option ``path`` names files that all machines see, comma-separated, ``table`` their table, ``rows`` the rows of a partition.

    Columns are long, double or string as the table declares them; a value of
    another type is null, or its text in a string column.
    """

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def _paths(self) -> list[str]:
        return [p.strip() for p in self.options["path"].split(",") if p.strip()]

    def schema(self) -> StructType:
        table = self.options.get("table", "threads")
        with _opened(self._paths()[0]) as db:
            columns = [(r[1], r[2]) for r in db.execute(f"PRAGMA table_info({_name(table)})")]
        return StructType([StructField(n, _KINDS.get((t or "").upper(), StringType())) for n, t in columns])

    def reader(self, schema: StructType) -> SqliteReader:
        return SqliteReader(self._paths(), self.options.get("table", "threads"), int(self.options.get("rows", ROWS)), schema)


class Range(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


class SqliteReader(DataSourceReader):
    """Ranges of rowids as partitions, filters in the database."""

    def __init__(self, paths: list[str], table: str, rows: int, schema: StructType):
        self.paths, self.table, self.rows, self.fields = paths, table, rows, schema
        self.where: list[str] = []
        self.values: list = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        kinds = {f.name: f.dataType for f in self.fields}
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            # texts may be stored as numbers and the other way round, which only Spark's own comparison tells
            plain = column in kinds and (isinstance(f, (IsNull, IsNotNull)) or (isinstance(kinds[column], LongType)))
            if plain and type(f) in _SIGNS and isinstance(f.value, int):
                self.where.append(f"{_name(column)} {_SIGNS[type(f)]} ?")
                self.values.append(f.value)
            elif plain and isinstance(f, In) and all(isinstance(v, int) for v in f.value):
                self.where.append(f"{_name(column)} IN ({', '.join('?' * len(f.value))})")
                self.values += f.value
            elif plain and isinstance(f, IsNotNull):
                self.where.append(f"{_name(column)} IS NOT NULL")
            yield f  # Spark looks again at what is left

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in self.paths:
            with _opened(path) as db:
                low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_name(self.table)}").fetchone()
            if low is not None:
                out += [Range(path, first, min(high, first + self.rows - 1)) for first in range(low, high + 1, self.rows)]
        return out or [Range("", 0, -1)]

    def read(self, partition: Range) -> Iterator[tuple]:
        if not partition.path:
            return
        columns = ", ".join(_name(f.name) for f in self.fields)
        where = " AND ".join(["rowid BETWEEN ? AND ?", *self.where])
        kinds = [{LongType: int, DoubleType: float, StringType: str}[type(f.dataType)] for f in self.fields]
        with _opened(partition.path) as db:
            for row in db.execute(f"SELECT {columns} FROM {_name(self.table)} WHERE {where}", [partition.first, partition.last, *self.values]):
                yield tuple(_fitted(v, k) for v, k in zip(row, kinds))


def _fitted(value: object, kind: type) -> object:
    if value is None or isinstance(value, kind):
        return value
    if kind is str:
        return value.decode("utf-8", "replace") if isinstance(value, bytes) else str(value)
    return float(value) if kind is float and isinstance(value, int) else None


def register(spark: SparkSession) -> None:
    """Make the sources known by name, with filters that go down to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteSource)


def register_readings(spark: SparkSession, name: str, function: Callable[[list[Row]], Iterable[tuple]], schema: str) -> None:
    """A table function for SQL that gives any number of readings for each session.

    ``SELECT * FROM name(TABLE(events) PARTITION BY (host, session_id) ORDER BY ord)``:
    ``function`` gets a session's rows in order; one session must fit a task.
    """

    class Readings:
        def __init__(self):
            self.rows = []

        def eval(self, row: Row):
            self.rows.append(row)

        def terminate(self):
            yield from function(self.rows)

    spark.udtf.register(name, udtf(Readings, returnType=schema))
