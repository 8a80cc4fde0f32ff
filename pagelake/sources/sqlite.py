"""A data source for SQLite files, read-only: spark.read.format("sqlite").option("path", …).option("dbtable", …).

One partition for each range of row numbers; filters on columns with simple values reach the database. Executors
open the file themselves, so it has to lie where all of them see it (or be shipped with SparkContext.addFile).
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import types as T

#: Declared types of the database and ours; anything else is text.
TYPES = {"INTEGER": T.LongType(), "INT": T.LongType(), "BOOLEAN": T.LongType(), "NUMERIC": T.DoubleType(), "REAL": T.DoubleType(), "BLOB": T.BinaryType()}
_ARROW = {T.LongType: pa.int64(), T.DoubleType: pa.float64(), T.BinaryType: pa.binary(), T.StringType: pa.string()}
BATCH = 10_000
PROJECT, BACKUP = "project.tpy", ".backup.tpy"


def connect(path: str) -> sqlite3.Connection:
    try:
        return sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True, timeout=5.0)
    except sqlite3.OperationalError as e:
        raise OSError(f"cannot read the database {Path(path).name}: {e}") from e


def database_in(path: str) -> str:
    """The database that a file, bundle or folder means: project.tpy first, else the first by name, never a backup."""
    p = Path(path).expanduser()
    if p.is_file() or (p.suffix == ".tpy" and not p.is_dir()):
        return str(p)
    named = sorted(x.name for x in p.glob("*.tpy") if not x.name.endswith(BACKUP)) if p.is_dir() else []
    return str(p / (PROJECT if PROJECT in named or not named else named[0]))


def _name(x: str) -> str:
    return '"' + x.replace('"', '""') + '"'


class SqliteSource(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> T.StructType:
        with connect(database_in(self.options["path"])) as c:
            rows = c.execute(f"PRAGMA table_info({_name(self.options['dbtable'])})").fetchall()
        if not rows:
            raise ValueError(f"no table {self.options['dbtable']}")
        return T.StructType([T.StructField(r[1], TYPES.get(r[2].upper().split("(")[0].strip(), T.StringType())) for r in rows])

    def reader(self, schema: T.StructType) -> D.DataSourceReader:
        return SqliteReader(schema, self.options)


class Part(D.InputPartition):
    def __init__(self, low: int | None, high: int | None):
        self.low, self.high = low, high


class SqliteReader(D.DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.columns = [(f.name, type(f.dataType)) for f in schema.fields]
        self.path, self.table, self.parts = database_in(options["path"]), options["dbtable"], int(options.get("numpartitions", "1"))
        self.where: list[tuple[str, object]] = []

    def pushFilters(self, filters: list[D.Filter]) -> Iterator[D.Filter]:
        signs = {D.EqualTo: "=", D.GreaterThan: ">", D.GreaterThanOrEqual: ">=", D.LessThan: "<", D.LessThanOrEqual: "<="}
        kinds = dict(self.columns)
        for f in filters:
            sign = signs.get(type(f))
            # text is left to Spark: the database's collations may compare it another way
            if sign and len(f.attribute) == 1 and kinds[f.attribute[0]] in (T.LongType, T.DoubleType):
                self.where.append((f"{_name(f.attribute[0])} {sign} ?", f.value))
            else:
                yield f

    def partitions(self) -> list[Part]:
        if self.parts <= 1:
            return [Part(None, None)]
        with connect(self.path) as c:
            low, high = c.execute(f"SELECT min(rowid), max(rowid) FROM {_name(self.table)}").fetchone()
        if low is None:
            return [Part(None, None)]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [Part(k, k + step) for k in range(low, high + 1, step)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        tests, values = [w for w, _ in self.where], [v for _, v in self.where]
        if part.low is not None:
            tests, values = [*tests, "rowid >= ?", "rowid < ?"], [*values, part.low, part.high]
        sql = f"SELECT {', '.join(_name(n) for n, _ in self.columns)} FROM {_name(self.table)}" + (" WHERE " + " AND ".join(tests) if tests else "")
        schema = pa.schema([(n, _ARROW[k]) for n, k in self.columns])
        convert = {T.LongType: int, T.DoubleType: float, T.StringType: str, T.BinaryType: bytes}
        c = connect(self.path)
        try:
            cursor = c.execute(sql, values)
            while rows := cursor.fetchmany(BATCH):
                cols = [[None if x is None else convert[k](x) for x in col] for col, (_, k) in zip(zip(*rows, strict=True), self.columns, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(cols, schema, strict=True)], schema=schema)
        finally:
            c.close()


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteSource)


def table(spark: SparkSession, path: str, name: str, partitions: int = 1):
    register(spark)
    return spark.read.format("sqlite").options(path=path, dbtable=name, numPartitions=partitions).load()
