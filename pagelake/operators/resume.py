"""Which work is already done: stage tables, skip reasons and the identity of what an output was made from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Stages to look in, best first, for each stage asked for.
FALLBACKS = {"structured": ("structured", "cleaned", "raw_ocr"), "translated": ("translated", "structured", "cleaned", "raw_ocr"), "cleaned": ("cleaned", "raw_ocr"), "raw_ocr": ("raw_ocr",)}


def may_resume(exists: Column, checksum: Column, photo_id: Column, known_checksum: Column, known_photo_id: Column) -> Column:
    """Whether an output may be used again.

    It has to exist; if both sides have a checksum those must agree, else if both have a photo id those; what
    can't be compared doesn't speak against it. Empty strings count as none.
    """
    a, b = F.nullif(checksum, F.lit("")), F.nullif(known_checksum, F.lit(""))
    same = F.coalesce(a == b, photo_id == known_photo_id, F.lit(True))
    return F.coalesce(exists, F.lit(False)) & same


def decide(items: DataFrame, done: DataFrame) -> DataFrame:
    """items with `resume`: a left join on stem with the stage's table (stem, checksum, photo_id)."""
    d = done.select("stem", F.col("checksum").alias("_c"), F.col("photo_id").alias("_p"), F.lit(True).alias("_there"))
    j = items.join(d, "stem", "left")
    return j.withColumn("resume", may_resume(F.col("_there"), F.col("checksum"), F.col("photo_id"), F.col("_c"), F.col("_p"))).drop("_c", "_p", "_there")


def open_work(items: DataFrame, done: DataFrame, force: bool = False) -> DataFrame:
    return items if force else items.join(done.select("stem"), "stem", "left_anti")


def skip_reason(selected: Column, exists: Column) -> Column:
    return F.when(~selected, "not_selected").when(exists, "already_exists")


def best_stage(stage: str, texts: dict[str, Column]) -> tuple[Column, Column]:
    """(name, text) of the first stage of the fallback order that has one."""
    have = [(s, F.nullif(texts[s], F.lit(""))) for s in FALLBACKS[stage] if s in texts]
    name = F.coalesce(*[F.when(t.isNotNull(), F.lit(s)) for s, t in have])
    return name, F.coalesce(*[t for _, t in have])
