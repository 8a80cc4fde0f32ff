"""Written intermediate tables: they cut lineage and survive lost executors."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a one- or two-key side that may be broadcast (under 64 MB); above it the same join shuffles.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a local one only where none is set, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.partition("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or f"{tempfile.gettempdir()}/pagelake-checkpoints").rstrip("/")


def unused(name: str, columns: list[str] | tuple[str, ...]) -> str:
    """name, with underscores until no column begins with it."""
    while any(c.lower().startswith(name.lower()) for c in columns):
        name += "_"
    return name


def with_text(documents: DataFrame, keep: tuple[str, ...], *more: Column) -> tuple[DataFrame, int]:
    """The columns of keep, the text unless it's among them, and more; and the place of the text."""
    if "text" in keep:
        return documents.select(*keep, *more), keep.index("text")
    return documents.select(*keep, F.col("text").alias(unused("text_", keep)), *more), len(keep)


def schema_of(documents: DataFrame, keep: tuple[str, ...], **added: T.DataType) -> T.StructType:
    clash = set(keep) & set(added)
    if clash:
        raise ValueError(f"columns {sorted(clash)} would be there twice; give a prefix")
    return T.StructType([*(documents.schema[c] for c in keep), *(T.StructField(n, t) for n, t in added.items())])


#: Writing rows of several MB each: their size is looked at row by row, not every 100 rows, and a row group has 32 MB.
WIDE_ROWS = {"parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "8", "parquet.block.size": str(1 << 25)}


def stash(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df written as Parquet below the shared folder, with the writer's options, and read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pagelake-{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a stashed table that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        drop_folder(df.sparkSession, path)


def drop_folder(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Fewer rows in each batch that goes to Python, for what runs inside: rows with whole texts or sets are large."""
    with _no_more(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": rows}):
        yield


@contextlib.contextmanager
def wide_rows(spark: SparkSession) -> Iterator[None]:
    """For rows of several MB each: Parquet is read 8 of them at a time (4,096 before), and a batch for Python has about 16 MB."""
    with _no_more(spark, {"spark.sql.parquet.columnarReaderBatchSize": 8, "spark.sql.execution.arrow.maxBytesPerBatch": 1 << 24}):
        yield


@contextlib.contextmanager
def _no_more(spark: SparkSession, limits: dict[str, int]) -> Iterator[None]:
    """Settings that are numbers lowered to these limits for what runs inside; 0 and less stand for no limit."""
    before = {k: spark.conf.get(k) for k in limits}
    for k, most in limits.items():
        now = int(before[k].rstrip("Bb"))
        spark.conf.set(k, str(min(most, now) if now > 0 else most))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if a count shows that it is within BROADCAST_ROWS, else df as it is."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
