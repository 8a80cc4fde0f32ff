"""Folders of page images, stage outputs, sidecars, manifests and accuracy corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# File types of pages, and of images in an accuracy corpus in order of preference.
PAGE_SUFFIXES = ("jpg", "jpeg", "png", "tif", "tiff", "pdf")
UPLOAD_BYTES = 50 * 1024 * 1024
SIDECAR = "source_file string, stage string, extracted_text string, engine string, model string, timestamp string, page int, total_pages int, checksum string, photo_id long, source_language string, skipped_translation boolean, _corrupt string"


def _local(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/+", "/")


def stem_of(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=[^.])\.[^.]*$", "")


def pages(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """path, stem, length of page files, one row a path; contents aren't read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path).select(_local(F.col("path")).alias("path"), "length")
    suffix = F.lower(F.element_at(F.split("path", r"\."), -1))
    return f.where(suffix.isin(*PAGE_SUFFIXES)).withColumn("stem", stem_of(F.col("path"))).dropDuplicates(["path", "stem"])


def stage_texts(spark: SparkSession, folder: str) -> DataFrame:
    """path, stem (below the folder, without suffix), text of every *.txt; files are split by file, never by line."""
    t = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    p = _local(F.col("_metadata.file_path"))
    base = folder.removeprefix("file:").rstrip("/")
    return t.select(p.alias("path"), F.regexp_replace(F.replace(p, F.lit(base + "/"), F.lit("")), r"\.txt$", "").alias("stem"), F.col("value").alias("text"))


def sidecars(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(records, corrupt ones); a broken file never stops the others."""
    t = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    path = _local(F.col("_metadata.file_path"))
    j = t.select(F.from_json("value", SIDECAR, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("j"), path.alias("path")).select("j.*", "path").withColumn("stem", stem_of(F.col("path")))
    return j.where("_corrupt is null").drop("_corrupt"), j.where("_corrupt is not null").select("path", "_corrupt")


def manifest(text: DataFrame, column: str = "text") -> DataFrame:
    """key, ord, entry (JSON) of a manifest's text, nested under "pages" or flat."""
    v = text.select(F.try_parse_json(column).alias("v"))
    nested = F.col("v").try_cast("map<string,variant>")["pages"]
    entries = F.coalesce(F.when(F.schema_of_variant(nested).startswith("OBJECT"), nested), F.col("v")).try_cast("map<string,variant>")
    e = v.select(F.posexplode(F.map_entries(entries)).alias("ord", "e"))
    return e.select("e.key", "ord", F.to_json("e.value").alias("entry"))


def accuracy_pairs(images: DataFrame, truths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, truth) by stem with the first image type that exists, and the truths without an image."""
    rank = F.array_position(F.array(*[F.lit(s) for s in PAGE_SUFFIXES]), F.lower(F.element_at(F.split("path", r"\."), -1)))
    best = images.groupBy("stem").agg(F.min_by("path", F.struct(rank, "path")).alias("image"))
    return truths.join(best, "stem"), truths.join(best, "stem", "left_anti")


def upload_name(raw: Column) -> Column:
    """The last part of a name, with either slash as separator; null if nothing but dots is left."""
    parts = F.filter(F.split(F.replace(F.coalesce(raw, F.lit("")), F.lit("\\"), F.lit("/")), "/"), lambda x: (x != "") & (x != "."))
    last = F.try_element_at(parts, F.lit(-1))
    return F.when(last != "..", last)


def uploads(files: DataFrame, taken: DataFrame, order: str) -> DataFrame:
    """files (name, length) with status and a free name: the lowest free of name, name_1, name_2 and so on, for each in its turn.

    Names are cut to their last part first; where none is left, the status is `invalid` and the name null. A number is in use if
    a taken name, or one of the files' own, has it. Before the used number u, the i-th of its name, u - i + 1 numbers are free;
    so the file at place n gets n and as many more as have no more than n free ones before them: a running count over
    files and used numbers in one order, however often a name comes.
    """
    suffix = lambda c: F.regexp_extract(c, r"(?<=[^.])(\.[^.]*)$", 1)
    clash = [c for c in files.columns if c.startswith("_")]
    if clash:
        raise ValueError(f"columns {clash} begin with an underscore")
    f = files.withColumn("_name", upload_name(F.col("name")))
    bad, f = f.where("_name is null"), f.where("_name is not null")
    f = f.withColumn("_place", F.row_number().over(Window.partitionBy("_name").orderBy(order)) - 1)
    names = taken.select("name", F.lit(True).alias("t")).union(f.select("_name", F.lit(False)).distinct())
    numbered = r"^(.*)_([1-9][0-9]{0,8})$"
    used = names.where(stem_of(F.col("name")).rlike(numbered)).select(
        F.concat(F.regexp_extract(stem_of(F.col("name")), numbered, 1), suffix("name")).alias("_name"), F.regexp_extract(stem_of(F.col("name")), numbered, 2).cast("long").alias("u")
    )
    used = used.union(names.where("t").select("name", F.lit(0).cast("long"))).distinct()
    before = F.col("u") - F.row_number().over(Window.partitionBy("_name").orderBy("u")) + 1
    both = f.withColumn("_used", F.lit(0)).unionByName(used.select("_name", before.cast("int").alias("_place"), F.lit(1).alias("_used")), allowMissingColumns=True)
    passed = F.sum("_used").over(Window.partitionBy("_name").orderBy("_place", F.desc("_used")).rowsBetween(Window.unboundedPreceding, 0))
    n = F.col("_place") + F.col("_passed")
    named = F.when(n > 0, F.concat(stem_of(F.col("_name")), F.lit("_"), n.cast("string"), suffix("_name"))).otherwise(F.col("_name"))
    status = F.when(F.col("length") > UPLOAD_BYTES, "too_large").otherwise("ok")
    out = both.withColumn("_passed", passed).where("_used = 0").select(*files.columns, named.alias("saved_as"), status.alias("status"))
    return out.unionByName(bad.select(*files.columns, F.lit(None).cast("string").alias("saved_as"), F.lit("invalid").alias("status")))
