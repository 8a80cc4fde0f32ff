"""Collecting pages for export: manifests, two languages, Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelake.functions.text import safe_name
from pagelake.operators.ordering import section_header
from pagelake.sources.files import stem_of as file_stem


def match_manifest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """files (path, stem) with the entry of a manifest (key, ord, entry): by whole key, else by the key's last part.

    Several keys with one last part: the last in the manifest's order wins.
    """
    by_stem = manifest.groupBy(file_stem(F.col("key")).alias("_stem")).agg(F.max_by("key", "ord").alias("_k"), F.max_by("entry", "ord").alias("_e"))
    exact = manifest.select(F.col("key").alias("_key"), F.col("entry").alias("_exact"))
    j = files.join(by_stem, files.stem == F.col("_stem"), "left").join(exact, files.stem == F.col("_key"), "left")
    return j.select(*files.columns, F.coalesce("_key", "_k").alias("matched_key"), F.coalesce("_exact", "_e").alias("entry"))


def first_entry(manifest: DataFrame) -> DataFrame:
    """stem, entry where, the other way round, the first key of a stem wins."""
    return manifest.groupBy(file_stem(F.col("key")).alias("stem")).agg(F.min_by("entry", "ord").alias("entry"))


def merge_manifest(old: DataFrame, new: DataFrame) -> DataFrame:
    """stem, entry: new entries replace old ones of their stem."""
    n = new.select("stem", F.col("entry").alias("_new"))
    return old.join(n, "stem", "full").select("stem", F.coalesce("_new", "entry").alias("entry"))


def bilingual(cleaned: DataFrame, translated: DataFrame) -> DataFrame:
    """label, original_text, translated_text by file stem; equal stems: the last path wins; none: ''."""
    last = lambda df, name: df.groupBy(file_stem(F.col("path")).alias("label")).agg(F.max_by("text", "path").alias(name))
    j = last(cleaned, "original_text").join(last(translated, "translated_text"), "label", "left")
    return j.select("label", "original_text", F.coalesce("translated_text", F.lit("")).alias("translated_text"))


def markdown(pages: DataFrame, book: str, order: list[str]) -> DataFrame:
    """book, markdown: pages (label, text, section) numbered in order, with a heading where the section changes.

    One string for each book is the feature; a book has to fit in a task.
    """
    w = Window.partitionBy(book).orderBy(*order)
    p = pages.select(book, "label", "text", F.row_number().over(w).alias("n"), section_header(F.col("section"), w).alias("h"))
    head = F.when(F.col("h").isNotNull(), F.concat(F.lit("## "), "h", F.lit("\n\n"))).otherwise("")
    part = F.concat(head, F.lit("### Page "), F.col("n").cast("string"), F.lit("\n\n["), F.coalesce("label", F.lit("")), F.lit("]\n\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    g = p.groupBy(book).agg(F.array_sort(F.collect_list(F.struct("n", part.alias("part")))).alias("t"))
    return g.select(book, F.concat(F.lit("# "), F.col(book).cast("string"), F.lit("\n\n"), F.array_join("t.part", "\n")).alias("markdown"))


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n"), F.trim), lambda x: x != "")


def bilingual_table(original: Column, translated: Column) -> Column:
    """A Markdown table of paragraphs side by side, the shorter side padded with empty cells; '' for no paragraphs."""
    cell = lambda x: F.replace(F.replace(F.coalesce(x, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    rows = F.transform(F.arrays_zip(paragraphs(original).alias("a"), paragraphs(translated).alias("b")), lambda r: F.concat(F.lit("| "), cell(r["a"]), F.lit(" | "), cell(r["b"]), F.lit(" |")))
    return F.when(F.size(rows) > 0, F.concat(F.lit("| Original | Translation |\n|---|---|\n"), F.array_join(rows, "\n"))).otherwise("")


def batch_name(stems: Column, minute: Column) -> Column:
    """The one top folder that all stems of a batch lie in, else 'batch', and a minute stamp."""
    tops = F.array_distinct(F.transform(stems, lambda s: F.when(F.contains(s, F.lit("/")), F.substring_index(s, "/", 1))))
    return F.concat_ws("-", safe_name(F.when(F.size(tops) == 1, F.coalesce(tops[0], F.lit("batch"))).otherwise("batch")), minute)


def note_plan(entries: DataFrame, photos: DataFrame, notes: DataFrame, target: str) -> DataFrame:
    """entries with `action`, the first that holds of foreign, empty, missing_photo, item_mismatch, duplicate, ready.

    entries: photo_id, item_id, text, project. photos: photo_id, item. notes: photo_id, text, compared as one line.
    """
    flat = lambda c: F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    known = notes.select("photo_id", flat(F.col("text")).alias("_note")).distinct().withColumn("_same", F.lit(True))
    j = entries.withColumn("_note", flat(F.col("text"))).join(photos.select("photo_id", F.col("item").alias("_item"), F.lit(True).alias("_there")), "photo_id", "left").join(known, ["photo_id", "_note"], "left")
    action = (
        F.when(~F.col("project").eqNullSafe(F.lit(target)), "foreign").when(F.coalesce("_note", F.lit("")) == "", "empty").when(F.col("_there").isNull(), "missing_photo")
        .when(F.col("item_id").isNotNull() & (F.coalesce("_item", F.lit(-1)) != F.col("item_id")), "item_mismatch").when(F.col("_same").isNotNull(), "duplicate").otherwise("ready")
    )
    return j.select(*entries.columns, action.alias("action"))


# What may become of an entry.
ACTIONS = ("ready", "duplicate", "empty", "foreign", "missing_photo", "item_mismatch", "error")


def plan_counts(plan: DataFrame, selected: int) -> DataFrame:
    """action, n of every action, none left out, and of `selected`, and `ineligible`: what was selected but can have no note."""
    every = plan.sparkSession.createDataFrame([(a,) for a in ACTIONS], "action string")
    n = plan.groupBy("action").agg(F.count(F.lit(1)).alias("n"))
    out = every.join(n, "action", "left").select("action", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    whole = F.lit(selected).cast("long")
    rest = plan.agg((whole - F.count(F.lit(1))).alias("ineligible"), whole.alias("selected")).select(F.expr("stack(2, 'ineligible', ineligible, 'selected', selected) AS (action, n)"))
    return out.unionByName(rest)
