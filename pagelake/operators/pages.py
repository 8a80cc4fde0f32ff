"""Pages of a run: which text counts, lines and regions, errors, engines, timings, selections, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POINT = "struct<x:int,y:int>"
STEP = "region_id string, error string"

# How providers say that a request is too long, and the two numbers they give.
TOO_LONG = ("exceed_context_size_error", "context_length_exceeded", "exceeds the available context size", "context length exceeded")
TOO_LONG_PHRASE = r"(?is)maximum context length.{0,80}?(however|you requested|resulted in|but you)"
TOKENS = r"(?is)\((\d+)\s+tokens?\).{0,40}?\((\d+)\s+tokens?\)"
# Kinds of documents that have a prompt of their own.
DOCUMENT_TYPES = ("default", "handwritten", "typed_clean", "technical", "formal", "casual", "multi_lang")
#: What is said about each kind, besides the common instruction.
HINTS = {
    "default": "Keep spelling and line order as on the page.",
    "handwritten": "The page is written by hand; mark what can't be read.",
    "typed_clean": "The page is printed cleanly; keep its paragraphs.",
    "technical": "Keep formulas, units and numbers exactly.",
    "formal": "Keep headings, numbering and signatures.",
    "casual": "A private letter; keep greetings and dates.",
    "multi_lang": "Several languages occur; translate none of them.",
}
INSTRUCTION = "Write down the text of this page and nothing else. "


def overlay(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """pages (stem, text) with the text of their page document (stem, page_text) where that has one; a document that couldn't be read has null."""
    known = documents.groupBy(F.col("stem").alias("_stem")).agg(F.max("page_text").alias("_text"))
    j = pages.join(known, F.col("stem") == F.col("_stem"), "left")
    return j.withColumn("text", F.coalesce(F.nullif("_text", F.lit("")), "text")).drop("_stem", "_text")


def stage_mix(pages: DataFrame) -> DataFrame:
    """stage, n: where the collected pages come from."""
    return pages.where("stage is not null").groupBy("stage").agg(F.count(F.lit(1)).alias("n"))


def region_errors(steps: DataFrame) -> DataFrame:
    """page, region_id, error from steps (page, pos, name, value) named region-error; the last of a region counts, what is no JSON or lacks either field doesn't."""
    s = steps.where("name = 'region-error'").select("page", "pos", F.from_json("value", STEP).alias("s")).where("s.region_id <> '' and s.error <> ''")
    return s.groupBy("page", F.col("s.region_id").alias("region_id")).agg(F.max_by("s.error", "pos").alias("error"))


def region_counts(regions: DataFrame, steps: DataFrame) -> DataFrame:
    """page, region_count, region_error_count; both sides are counted before they meet."""
    r = regions.groupBy("page").agg(F.count(F.lit(1)).alias("region_count"))
    e = steps.where("name = 'region-error'").groupBy("page").agg(F.count(F.lit(1)).alias("region_error_count"))
    return r.join(e, "page", "left").na.fill(0, ["region_error_count"])


def lines_to_regions(lines: DataFrame, regions: DataFrame, prefix: str = "kraken") -> DataFrame:
    """page, region, type, polygon, order, lines of detected lines and regions.

    lines: page, pos (reading order), region_ids, boundary, baseline. regions: page, nth (from 0), id, type, boundary. A line
    belongs to the first of its region_ids that the page has; lines without one make a further region, their bounding box.
    Regions are ordered by their first line; those without lines count as many places as there are regions with lines.
    Lines without any point are left out.
    """
    has = lambda c: F.size(F.coalesce(c, F.array().cast(f"array<{POINT}>"))) > 0
    kept = lines.where(has(F.col("boundary")) | has(F.col("baseline")))
    kept = kept.select("page", "pos", F.lit(True).alias("is_line"), F.col("region_ids").alias("ids"), F.when(has(F.col("boundary")), F.col("boundary")).otherwise(F.col("baseline")).alias("points"))
    areas = regions.select("page", F.lit(False).alias("is_line"), F.array("id").alias("ids"), F.col("boundary").alias("points"), "nth", "type")
    # lines and regions in one table, both dealt by page before they meet (the union keeps that): no row is shuffled again
    page = Window.partitionBy("page")
    kept = kept.withColumn("n", F.row_number().over(page.orderBy("pos")))
    rows = kept.unionByName(areas.repartition("page"), allowMissingColumns=True)
    rows = rows.withColumn("known", F.collect_list(F.when(~F.col("is_line"), F.struct(F.col("ids")[0].alias("id"), "nth"))).over(page))
    nth_of = lambda known: F.array_max(F.transform(known, lambda r: r["nth"]))
    owners = F.transform("ids", lambda i: nth_of(F.filter("known", lambda r: r["id"] == i)))
    rows = rows.withColumn("owner", F.when(F.col("is_line"), F.get(F.filter(owners, lambda k: k.isNotNull()), F.lit(0))).otherwise(F.col("nth")))
    rows = rows.select("*", F.col("owner").isNull().alias("orphan"), F.concat(F.lit(f"{prefix}-line-"), F.lpad(F.col("n").cast("string"), 4, "0")).alias("line"))
    rows = rows.withColumn("nth", F.coalesce("owner", nth_of(F.col("known")) + 1, F.lit(0)))
    points = F.flatten(F.collect_list(F.when(F.col("orphan"), F.col("points"))))
    listed = F.array_sort(F.collect_list(F.when(F.col("is_line"), F.struct("pos", "line"))))
    r = rows.groupBy("page", "nth").agg(
        F.min("pos").alias("first"), listed.alias("l"), points.alias("p"), F.max("orphan").alias("orphan"), F.max("type").alias("type"),
        F.first(F.when(~F.col("is_line"), F.col("points")), ignorenulls=True).alias("boundary"),
    )
    x, y = F.transform("p", lambda v: v["x"]), F.transform("p", lambda v: v["y"])
    corner = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    box = F.array(corner(F.array_min(x), F.array_min(y)), corner(F.array_max(x), F.array_min(y)), corner(F.array_max(x), F.array_max(y)), corner(F.array_min(x), F.array_max(y)))
    r = r.withColumn("seen", F.count("first").over(page))
    place = F.row_number().over(page.orderBy(F.coalesce(F.col("first"), F.col("seen")), "nth")) - 1
    return r.select(
        "page", F.concat(F.lit(f"{prefix}-"), F.lpad((F.col("nth") + 1).cast("string"), 4, "0")).alias("region"), F.coalesce("type", F.lit("unclassified")).alias("type"),
        F.coalesce("boundary", F.when(F.col("orphan"), box)).alias("polygon"), place.alias("order"), F.col("l.line").alias("lines"),
    )


def full_page(width: Column, height: Column) -> Column:
    """The one region of a page that isn't segmented; null without a size."""
    at = lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))
    zero = F.lit(0)
    return F.when((width > 0) & (height > 0), F.array(at(zero, zero), at(width, zero), at(width, height), at(zero, height)))


def engine_label(engines: Column, default: str = "vision") -> Column:
    """Engines in order, each once, joined by '+'; the default's name for none."""
    return F.when(F.size(engines) > 0, F.array_join(F.array_distinct(engines), "+")).otherwise(default)


def union_of(first: Column, *rest: Column) -> Column:
    """Elements of all lists in order, each where it comes first."""
    return F.array_distinct(F.concat(first, *rest))


def timings(results: DataFrame) -> DataFrame:
    """results (file, stage, elapsed, skipped) as file, elapsed, and how many stages ran; a skipped stage took no time."""
    spent = F.when(F.coalesce("skipped", F.lit(False)), 0.0).otherwise(F.coalesce("elapsed", F.lit(0.0)))
    return results.groupBy("file").agg(F.sum(spent).alias("elapsed"), F.count_if(~F.coalesce("skipped", F.lit(False))).alias("ran"))


def select_photos(photos: DataFrame, chosen: DataFrame) -> DataFrame:
    """item_id, photos: the chosen photos (photo_id) of each item, in order; items without any are left out."""
    return photos.join(chosen.select("photo_id").distinct(), "photo_id", "left_semi").groupBy("item_id").agg(F.array_sort(F.collect_list("photo_id")).alias("photos"))


def writable(items: DataFrame) -> DataFrame:
    """Items that can be written back: those with a photo id."""
    return items.where("photo_id is not null")


def of_origin(items: DataFrame, origin: str) -> DataFrame:
    return items.where(F.col("origin") == origin)


def items_of(items: DataFrame, run_id: int) -> DataFrame:
    return items.where(F.col("run_id") == run_id).orderBy("item_id")


def note_language(value: Column) -> Column:
    """A code of up to three letters in lower case, else 'en'."""
    code = F.lower(F.trim(F.coalesce(value, F.lit("en"))))
    return F.when(code.rlike(r"^\p{L}{1,3}$"), code).otherwise("en")


def cell_text(text: Column) -> Column:
    """A paragraph on one line: line breaks as blanks, runs of blanks as one."""
    return F.regexp_replace(F.replace(text, F.lit("\n"), F.lit(" ")), "  +", " ")


def escape_markup(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def model_error(error: Column) -> Column:
    """struct<kind, needed, window>: 'context' for a request that is too long, with its tokens and the window if they are told; 'missing' for a 404; else 'other'. Null for no error."""
    low = F.lower(error)
    long = low.rlike(TOO_LONG_PHRASE)
    for phrase in TOO_LONG:
        long = long | F.contains(low, F.lit(phrase))
    number = lambda k: F.when(long, F.nullif(F.regexp_extract(error, TOKENS, k), F.lit("")).cast("int"))
    kind = F.when(long, "context").when(error.rlike(r"(?<!\d)404(?!\d)"), "missing").otherwise("other")
    return F.when(error.isNotNull(), F.struct(kind.alias("kind"), number(1).alias("needed"), number(2).alias("window")))


def percent(ratio: Column) -> Column:
    """A share as whole per cent, halves to the even one."""
    return F.concat(F.bround(ratio * 100, 0).cast("long").cast("string"), F.lit("%"))


def prompt_of(kind: Column) -> Column:
    hints = F.create_map(*[F.lit(x) for k in DOCUMENT_TYPES for x in (k, HINTS[k])])
    return F.concat(F.lit(INSTRUCTION), F.coalesce(hints[F.coalesce(kind, F.lit(""))], F.lit(HINTS["default"])))


def utc_now() -> Column:
    """Now, to the second, as ISO text; the session's time zone has to be UTC."""
    return F.date_format(F.date_trunc("SECOND", F.current_timestamp()), "yyyy-MM-dd'T'HH:mm:ssXXX")


def closed_states(state: Column, cancelled: Column) -> Column:
    """A stage's state once its run has ended: what waits or runs is cancelled or skipped."""
    return F.when(state.isin("pending", "running"), F.when(cancelled, "cancelled").otherwise("skipped")).otherwise(state)
