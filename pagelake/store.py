"""Written intermediate tables in the folder that the cluster shares: they cut lineage and outlive executors."""

from __future__ import annotations

import contextlib
import contextvars
import math
import tempfile
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a side of one or two numbers that may be broadcast (under 64 MB); above it the same join shuffles.
BROADCAST_ROWS = 1_000_000
_scope: contextvars.ContextVar[str | None] = contextvars.ContextVar("pagelake_scope", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a local one only where none is set, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or f"{tempfile.gettempdir()}/pagelake-checkpoints").rstrip("/")


def file_system(spark: SparkSession, path: str):
    """The file system that a path is in, and the path, as Hadoop has them."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def task_store(folder: str):
    """The file system that a folder's address names, and the folder in it, as tasks have them (pyarrow)."""
    import pyarrow.fs as fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def dealt(rows: DataFrame, each: int) -> DataFrame:
    """rows dealt over tasks of about `each`, after a count: for rows that take much more time than their bytes tell."""
    return rows.repartition(max(1, math.ceil(rows.count() / each)))


def stash(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet below the shared folder and read again."""
    path = f"{_scope.get() or shared_dir(df.sparkSession)}/pagelake-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[str]:
    """Tables that are stashed inside lie in a folder of their own, which goes at the end: write what is to stay before that."""
    folder = f"{shared_dir(spark)}/pagelake-scope-{uuid.uuid4().hex}"
    token = _scope.set(folder)
    try:
        yield folder
    finally:
        _scope.reset(token)
        fs, p = file_system(spark, folder)
        fs.delete(p, True)


def sweep(spark: SparkSession, hours: float) -> int:
    """Delete this engine's folders in the shared one that nothing was written to for that long; the number of them."""
    fs, p = file_system(spark, shared_dir(spark))
    if not fs.exists(p):
        return 0
    old = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName().startswith("pagelake-") and s.getModificationTime() < (time.time() - 3600 * hours) * 1000]
    for path in old:
        fs.delete(path, True)
    return len(old)


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if a count shows that it is within BROADCAST_ROWS, else df as it is."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
