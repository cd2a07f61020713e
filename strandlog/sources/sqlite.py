"""Tables of SQLite files as a batch source: read by ranges of rowid, with filters and columns handed to the database.

Options: path, table; partitions (ranges of rowid, by default one for about 100,000 rows). The file must be reachable from
the driver and the executors under one path; it is opened read-only. Integers, reals, texts and blobs keep their kind by
the column's declared type; a value that doesn't fit it is null. A view or a table without rowid is one range.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import batched

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import BinaryType, DataType, DoubleType, LongType, StringType, StructField, StructType

RANGE_ROWS = 100_000
BATCH = 10_000
_COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


@dataclass
class Rowids(InputPartition):
    """Rows of low <= rowid < high; of all rows without low."""

    low: int | None
    high: int | None


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _open(path: str) -> sqlite3.Connection:
    plain = path.removeprefix("file://").removeprefix("file:")
    return sqlite3.connect(f"file:{plain.replace('?', '%3f').replace('#', '%23')}?mode=ro", uri=True)


def _kind(declared: str) -> DataType:
    """The type by the database's own rules for declared types."""
    declared = declared.upper()
    if "INT" in declared:
        return LongType()
    if any(x in declared for x in ("CHAR", "CLOB", "TEXT")):
        return StringType()
    if any(x in declared for x in ("REAL", "FLOA", "DOUB")):
        return DoubleType()
    return BinaryType() if "BLOB" in declared else StringType()


def _value(x, kind: DataType):
    if isinstance(kind, LongType):
        return x if isinstance(x, int) else None
    if isinstance(kind, DoubleType):
        return float(x) if isinstance(x, (int, float)) else None
    if isinstance(kind, BinaryType):
        return x if isinstance(x, bytes) else None
    return None if isinstance(x, bytes) else x if x is None or isinstance(x, str) else str(x)


class Rows(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.table, self.ranges = options["path"], options["table"], int(options.get("partitions", 0))
        self.schema, self.where, self.given = schema, [], []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        kinds = {f.name: f.dataType for f in self.schema}
        for f in filters:
            name = getattr(f, "attribute", ("",))[0]
            kind, column = kinds.get(name), _quoted(name)
            exact = isinstance(kind, (LongType, StringType))  # of columns whose stored values may be of another kind Spark judges as well
            if kind is None or len(f.attribute) != 1:
                yield f
            elif type(f) in _COMPARED and isinstance(f.value, (int, str)) and not isinstance(f.value, bool) and exact:
                self.where.append(f"{column} {_COMPARED[type(f)]} ?")
                self.given.append(f.value)
                yield f
            elif isinstance(f, In) and f.value and len(f.value) < 500 and exact and all(isinstance(v, (int, str)) for v in f.value):
                self.where.append(f"{column} IN ({', '.join('?' * len(f.value))})")
                self.given += f.value
                yield f
            elif isinstance(f, IsNotNull):
                self.where.append(f"{column} IS NOT NULL")
                yield f
            else:
                yield f

    def partitions(self) -> list[Rowids]:
        with _open(self.path) as db:
            try:
                low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
            except sqlite3.OperationalError:  # a table without rowid
                return [Rowids(None, None)]
        if low is None:  # an empty table or a view
            return [Rowids(None, None)]
        n = self.ranges or max(1, (high - low) // RANGE_ROWS)
        step = -(-(high + 1 - low) // n)
        return [Rowids(x, x + step) for x in range(low, high + 1, step)]

    def read(self, part: Rowids) -> Iterator[pa.RecordBatch]:
        kinds = [f.dataType for f in self.schema]
        arrow = pa.schema([(f.name, {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}[f.dataType.simpleString()]) for f in self.schema])
        where, given = list(self.where), list(self.given)
        if part.low is not None:
            where, given = [*where, "rowid >= ?", "rowid < ?"], [*given, part.low, part.high]
        columns = ", ".join(_quoted(f.name) for f in self.schema) or "1"
        query = f"SELECT {columns} FROM {_quoted(self.table)}" + (f" WHERE {' AND '.join(where)}" if where else "")
        with _open(self.path) as db:
            for rows in batched(db.execute(query, given), BATCH):
                arrays = [pa.array([_value(r[i], kind) for r in rows], arrow.field(i).type) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)


class Sqlite(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> StructType:
        with _open(self.options["path"]) as db:
            found = db.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
        if not found:
            raise ValueError(f"no table {self.options['table']} in {self.options['path']}")
        return StructType([StructField(x[1], _kind(x[2] or "")) for x in found])

    def reader(self, schema: StructType) -> Rows:
        return Rows(dict(self.options), schema)


def read_table(spark: SparkSession, path: str, table: str, partitions: int = 0) -> DataFrame:
    spark.dataSource.register(Sqlite)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("sqlite_table").options(path=path, table=table, partitions=partitions).load()


def tables(path: str) -> list[str]:
    """The tables and views of a file."""
    with _open(path) as db:
        return [x[0] for x in db.execute("SELECT name FROM sqlite_master WHERE type IN ('table', 'view') AND name NOT LIKE 'sqlite_%' ORDER BY 1")]


def attach(spark: SparkSession, name: str, path: str) -> list[str]:
    """The tables of a file as views `name`_`table`, to be joined with the session's; returns the views' names."""
    out = []
    for table in tables(path):
        read_table(spark, path, table).createOrReplaceTempView(f"{name}_{table}")
        out.append(f"{name}_{table}")
    return out


def write_table(df: DataFrame, path: str, table: str) -> None:
    """df as a new table of a file, which one task writes: for results of a size that one file is meant for."""
    kinds = {"bigint": "INTEGER", "int": "INTEGER", "smallint": "INTEGER", "tinyint": "INTEGER", "boolean": "INTEGER", "double": "REAL", "float": "REAL", "binary": "BLOB"}
    declared = ", ".join(f"{_quoted(n)} {kinds.get(t, 'TEXT')}" for n, t in df.dtypes)
    plain = path.removeprefix("file://").removeprefix("file:")
    text = df.select(*(df[n] if t in kinds else df[n].cast("string") for n, t in df.dtypes))

    marks = ", ".join("?" * len(df.columns))

    def write(rows: Iterator) -> None:
        with sqlite3.connect(plain) as db:
            db.execute(f"DROP TABLE IF EXISTS {_quoted(table)}")  # of an earlier attempt
            db.execute(f"CREATE TABLE {_quoted(table)} ({declared})")
            db.executemany(f"INSERT INTO {_quoted(table)} VALUES ({marks})", map(tuple, rows))

    text.coalesce(1).foreachPartition(write)
