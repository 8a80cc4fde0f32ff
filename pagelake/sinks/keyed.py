"""Tables with a key, in buckets of it: a change rewrites the buckets that it touches and no others.

A bucket is a partition folder, replaced by dynamic partition overwrite: new files are staged, and put in place when all
tasks are through, so a write that breaks off leaves the old files. Every bucket that was written has a marker row, so one
whose last row goes is replaced as well.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.store import file_system

LIVE, BUCKET = "_live", "_bucket"


@dataclass(frozen=True)
class KeyedTable:
    """Rows of `schema`, one a key. Choose buckets so that one has some hundred MB; their number stays as it is."""

    spark: SparkSession
    path: str
    schema: T.StructType
    key: tuple[str, ...]
    buckets: int = 32

    def _all(self) -> DataFrame | None:
        kinds = T.StructType([*self.schema, T.StructField(LIVE, T.BooleanType()), T.StructField(BUCKET, T.IntegerType())])
        try:
            return self.spark.read.schema(kinds).parquet(f"{self.path}/rows")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def read(self) -> DataFrame:
        rows = self._all()
        return self.spark.createDataFrame([], self.schema) if rows is None else rows.where(LIVE).drop(LIVE, BUCKET)

    def _bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _touched(self, keys: DataFrame) -> tuple[list[int], DataFrame]:
        """Buckets of keys (at most `buckets` numbers), and the rows that they have now."""
        touched = sorted(r[0] for r in keys.select(self._bucket()).distinct().collect())
        rows = self._all()
        none = self.spark.createDataFrame([], self.schema)
        return touched, none if rows is None else rows.where(F.col(BUCKET).isin(touched) & F.col(LIVE)).drop(LIVE, BUCKET)

    def _dealt(self, touched: list[int], rows: DataFrame, new: DataFrame) -> DataFrame:
        """Rows (_new 0), new ones (_new 1) and a marker for each touched bucket, dealt by bucket: the one shuffle of a change."""
        names = self.schema.names
        marks = self.spark.createDataFrame([(b,) for b in touched], f"{BUCKET} int").select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema], F.lit(False).alias(LIVE), BUCKET, F.lit(0).alias("_new"))
        told = [d.select(*names, F.lit(True).alias(LIVE), self._bucket().alias(BUCKET), F.lit(n).alias("_new")) for n, d in enumerate((rows, new))]
        return told[0].unionByName(told[1]).unionByName(marks).repartition(len(touched), BUCKET)

    def _replace(self, rows: DataFrame) -> None:
        """The buckets of the rows with these alone: one file each, and its marker."""
        rows.select(*self.schema.names, LIVE, BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(f"{self.path}/rows")

    @contextlib.contextmanager
    def _written(self, changes: DataFrame) -> Iterator[DataFrame]:
        """Changes, worked out once: they are read for their buckets and again for their rows."""
        path = f"{self.path}/changes-{uuid.uuid4().hex}"
        changes.write.parquet(path)
        try:
            yield self.spark.read.schema(changes.schema).parquet(path)
        finally:
            fs, p = file_system(self.spark, path)
            fs.delete(p, True)

    def _same(self) -> list:
        """What rows of one key share; they are in one bucket, so a window over it needs no shuffle of its own. A marker is none of them."""
        return [BUCKET, LIVE, *self.key]

    def upsert(self, changes: DataFrame, version: str | None = None, batch: int | None = None) -> bool:
        """Rows of changes take the place of those with their key. With a version the highest wins, among changes too; without, keys come once.

        A batch with a number counts once: one that is through before returns False and changes nothing. Null keys are keys like others.
        """
        if batch is not None and self._seen(batch):
            return False
        with self._written(changes.select(*self.schema.names)) as new:
            touched, rows = self._touched(new)
            if touched:
                order = [F.desc(version)] if version else []
                best = Window.partitionBy(*self._same()).orderBy(*order, F.desc("_new"))
                self._replace(self._dealt(touched, rows, new).withColumn("_nth", F.row_number().over(best)).where("_nth = 1"))
        if batch is not None:
            self._mark(batch)
        return True

    def delete(self, keys: DataFrame) -> None:
        """Rows with these keys go."""
        with self._written(keys.select(*self.key)) as gone:
            touched, rows = self._touched(gone)
            if touched:
                rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema if f.name not in self.key]
                both = self._dealt(touched, rows, gone.select("*", *rest))
                self._replace(both.withColumn("_gone", F.max("_new").over(Window.partitionBy(*self._same()))).where("_gone = 0"))

    def _seen(self, batch: int) -> bool:
        fs, p = file_system(self.spark, f"{self.path}/batches/{batch}")
        return fs.exists(p)

    def _mark(self, batch: int) -> None:
        fs, p = file_system(self.spark, f"{self.path}/batches/{batch}")
        fs.create(p, True).close()

    def files(self) -> dict[int, list[str]]:
        """Names of the data files by bucket."""
        rows = self._all()
        if rows is None:
            return {}
        found: dict[int, list[str]] = {}
        for f in rows.inputFiles():
            folder, name = f.rsplit("/", 2)[-2:]
            found.setdefault(int(folder.partition("=")[2]), []).append(name)
        return found
