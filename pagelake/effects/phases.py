"""Stages one after the other over all items: each phase's table is complete before the next phase starts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame

from pagelake.operators.resume import open_work

Phase = Callable[[DataFrame], DataFrame]
ROW = "stem string, text string"


def table(items: DataFrame, path: str) -> DataFrame:
    """A phase's rows so far; none if it hasn't run yet."""
    spark = items.sparkSession
    try:
        return spark.read.schema(ROW).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ROW)


def run(items: DataFrame, phases: list[tuple[str, Phase]], folder: str) -> DataFrame:
    """The last phase's rows (stem, text) of items (stem, text). What a phase's table has already isn't worked on again.

    Items that a phase leaves out are open there when the run is repeated. A phase writes one table in one job, so one that is broken off leaves no rows.
    """
    current = items.select("stem", "text")
    for name, work in phases:
        path = f"{folder}/{name}"
        work(open_work(current, table(items, path))).select("stem", "text").write.mode("append").parquet(path)
        current = table(items, path).join(current.select("stem"), "stem", "left_semi")
    return current
