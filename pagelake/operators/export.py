"""A batch of pages for export: what is there, what is skipped, names, titles, copies of page documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.functions.text import slug
from pagelake.operators.collect import markdown

# Stages to take a page's text from, best first, for each stage asked for, and what a file name can't hold.
EXPORTED = {"translated": ("translated", "cleaned", "raw_ocr"), "cleaned": ("cleaned", "raw_ocr", "translated"), "raw_ocr": ("raw_ocr", "cleaned", "translated")}
FORBIDDEN = r'[<>:"/\\|?*]'


def file_name(stem: Column, suffix: str = "") -> Column:
    """A stem as one file name; 'batch' for a blank one."""
    return F.concat(F.coalesce(F.nullif(F.trim(F.regexp_replace(stem, FORBIDDEN, "_")), F.lit("")), F.lit("batch")), F.lit(suffix))


def default_name(folder: Column, bilingual: bool = False, canonical: bool = True, suffix: str = ".md") -> Column:
    """An export's name after its folder; canonical projects have it as a slug."""
    name = F.element_at(F.split(F.regexp_replace(folder, "/+$", ""), "/"), -1)
    return F.concat(slug(name) if canonical else name, F.lit(("_bilingual" if bilingual else "") + suffix))


def collected(stems: DataFrame, texts: DataFrame, stage: str = "cleaned") -> tuple[DataFrame, DataFrame]:
    """(stems with stage and text, the stems without any): the first stage in EXPORTED's order that isn't empty. texts: stem, stage, text."""
    order = F.array(*[F.lit(s) for s in EXPORTED.get(stage, EXPORTED["cleaned"])])
    have = texts.where(F.coalesce(F.trim("text"), F.lit("")) != "").withColumn("_k", F.array_position(order, F.col("stage"))).where("_k > 0")
    best = have.groupBy("stem").agg(F.min_by(F.struct("stage", "text"), "_k").alias("_b"))
    return stems.join(best, "stem").select(*stems.columns, "_b.stage", "_b.text"), stems.join(best, "stem", "left_anti")


def shared_title(pages: DataFrame, by: str, title: str = "item_title") -> DataFrame:
    """by, title: the one title that all of a batch's titled pages share, else null."""
    t = F.nullif(F.col(title), F.lit(""))
    return pages.groupBy(by).agg(F.when(F.min(t) == F.max(t), F.max(t)).alias("title"))


def export_batches(stems: DataFrame, texts: DataFrame, stage: str = "cleaned") -> tuple[DataFrame, DataFrame]:
    """(batch, title, markdown; batch, n_skipped) of stems (batch, ord, stem, item_title): a book of each batch in order, items as headings.

    A book is one string, as the format wants it. The heading is the title all pages share, else the batch's name.
    """
    pages, lost = collected(stems, texts, stage)
    titles = shared_title(pages, "batch")
    p = pages.join(titles, "batch").select("batch", F.coalesce("title", F.col("batch").cast("string")).alias("book"), "ord", F.col("stem").alias("label"), "text", F.coalesce("item_title", F.lit("")).alias("section"))
    books = markdown(p.withColumn("key", F.struct("batch", "book")), "key", ["ord"])
    head = F.concat(F.lit("# "), "key.book", F.lit("\n\n"))
    body = F.substring(F.col("markdown"), F.instr("markdown", "\n\n") + 2, F.length("markdown"))
    return books.select("key.batch", F.col("key.book").alias("title"), F.concat(head, body).alias("markdown")), lost.groupBy("batch").agg(F.count(F.lit(1)).alias("n_skipped"))


def page_documents(stems: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stem, file, xml to be written; stems without a document). documents: stem, xml."""
    j = stems.join(documents.select("stem", "xml"), "stem")
    return j.select("stem", file_name(F.col("stem"), ".xml").alias("file"), "xml"), stems.join(documents, "stem", "left_anti").select("stem")


def nearest_document(wanted: DataFrame, documents: DataFrame) -> DataFrame:
    """wanted (folder, stem) with root and page of the document (root, stem, page) in the folder itself or the nearest one above it.

    A document that can't be read (page null) ends the search: it isn't replaced by one further up.
    """
    parts = F.split(F.regexp_replace("folder", "/+$", ""), "/")
    above = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    w = wanted.select("folder", "stem").distinct().select("folder", "stem", F.posexplode(above).alias("_up", "root"))
    near = w.join(documents, ["root", "stem"]).groupBy("folder", "stem").agg(F.min_by(F.struct("root", "page"), "_up").alias("_d"))
    return wanted.join(near, ["folder", "stem"], "left").select(*wanted.columns, "_d.root", "_d.page")


def recent_projects(state: DataFrame, existing: DataFrame) -> DataFrame:
    """place, path of the projects in a state text's "recent" list that exist (path); texts, lists or entries of other kinds give none."""
    recent = F.try_parse_json("text").try_cast("map<string,variant>")["recent"]
    entries = F.when(F.schema_of_variant(recent).startswith("ARRAY"), recent.try_cast("array<variant>"))
    e = state.select(F.posexplode(entries).alias("place", "v")).select("place", F.when(F.schema_of_variant("v") == "STRING", F.col("v").try_cast("string")).alias("path"))
    return e.join(existing.select("path").distinct(), "path", "left_semi").select("place", "path")
