"""Run events as a stream: item states, run totals, and history rows written once.

Lateness policy: events are deduplicated by event_id within the watermark; a fold keeps the newest by event_id, so
the order of arrival doesn't matter and a batch over the same events gives the same states.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENTS = T.StructType(
    [T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())]
)
#: Item states by event kind; 'running' follows any kind not named here.
FINAL = {"purchase": "done", "error": "failed", "signup": "pending"}


def events(spark: SparkSession, path: str, files_at_once: int = 1) -> DataFrame:
    """A stream over a folder of Parquet files."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_at_once).parquet(path)


def fold(e: DataFrame) -> DataFrame:
    """user_id (the item), n, done, failed, last_kind: the same aggregate for batches and, in update mode, streams."""
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "purchase").alias("done"), F.count_if(F.col("event_type") == "error").alias("failed"), F.max_by("event_type", "event_id").alias("last_kind"))


def once(e: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each event once, within the watermark."""
    return e.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def windowed(e: DataFrame, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Counts and values by window and kind; late events up to `delay` count."""
    w = e.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "event_type")
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def state_of(kind: F.Column) -> F.Column:
    out = F.lit("running")
    for k, v in FINAL.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def record(items: DataFrame, read: Callable[[], DataFrame | None], write: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: history rows of finished items that aren't recorded yet, so a repeated batch adds nothing."""

    def run(batch: DataFrame, _: int) -> None:
        done = batch.where(state_of(F.col("event_type")).isin("done", "failed")).groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("kind"))
        known = read()
        fresh = done if known is None else done.join(known.select("user_id"), "user_id", "left_anti")
        write(fresh.select("user_id", state_of(F.col("kind")).alias("state")))

    return run
