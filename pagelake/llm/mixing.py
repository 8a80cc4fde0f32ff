"""Mixing sources to target weights with DataFrame functions only.

Documents get hash-random keys, keys split each source into ranges, the ranges' token counts give prefix sums
at every range border, and only the running sum inside a range needs its rows in order. No task holds a whole
source, so a source with a third of all rows costs no more than thirty small ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelake.llm.store import small, stash, unused

#: Hex digits of the random key that number a source's ranges: 4096 ranges a source.
RANGE_DIGITS = 3
#: No source, and no document, is taken more often than this.
MOST_EPOCHS = 3


def n_words(text: Column) -> Column:
    """Words of a text (null: 0). Each word becomes one letter, then the spaces go."""
    letters = F.translate(F.regexp_replace(text, "[^\\x20\\x09-\\x0D]++", "w"), " \t\n\x0b\x0c\r", "")
    return F.coalesce(F.length(letters), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """One row a source: source, source_size, target.

    Sources by code point, null last, get the weights in turn and share all sizes by them. A target stops at
    MOST_EPOCHS times its source's size and the rest is shared again by weight. Sorted by limit per weight, the
    sources that reach their limits come first, so one pass of running sums finds the last share.
    """
    total = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    s = total.select("source", "source_size", weight.alias("w"), (F.col("source_size") * float(MOST_EPOCHS)).alias("most"))
    everything = Window.partitionBy(F.lit(0))
    before = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = s.select(
        "*",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))).alias("left"),
        (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))).alias("left_w"),
    )
    # a source is at its limit if even the share of the sources not before it passes that limit
    s = s.withColumn("full", F.col("left") * F.col("w") >= F.col("most") * F.col("left_w"))
    # of the others, the first in that order has the most weight left; its share is everyone's
    first = F.max(F.when(~F.col("full"), F.struct("left_w", "left"))).over(everything)
    s = s.withColumn("share", first["left"] / first["left_w"])
    return s.select("source", "source_size", F.when(F.col("full"), F.col("most")).otherwise(F.col("share") * F.col("w")).alias("target"))


def _placed(documents: DataFrame, weights: tuple[int, ...], text: str) -> DataFrame:
    """doc_id, source, key, size, source_size, target, budget, epochs; start and end: words of its source up to the row, and up to the last row of its key, id and size."""
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    d = documents.select("doc_id", "source", n_words(F.col(text)).alias("size"), key.alias("key"))
    d = d.withColumn("range", F.substring("key", 1, RANGE_DIGITS))
    sums = d.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    targets = source_targets(sums.select("source", F.col("range_size").alias("size")), weights)
    by_range = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = sums.withColumn("before", F.coalesce(F.sum("range_size").over(by_range), F.lit(0)))
    ranges = ranges.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s", "range_size")
    budget = F.floor("target").cast("long")
    ranges = ranges.select(
        F.col("source").alias("s"), F.col("range").alias("r"), "before", "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long").alias("epochs"), budget.alias("budget"),
    )
    d = d.join(ranges, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    order = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size")
    start = F.col("before") + F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    end = F.col("before") + F.sum("size").over(order.rangeBetween(Window.unboundedPreceding, 0))
    return d.select("doc_id", "source", "key", "size", "source_size", "target", "budget", "epochs", start.alias("start"), end.alias("end"))


def _part() -> Column:
    """Words that the partial epoch takes of a row: what is left of the budget after whole epochs, from its start on."""
    rest = F.col("budget") - F.col("epochs") * F.col("source_size")
    return F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start"))).cast("long")


def mix_plan(documents: DataFrame, weights: tuple[int, ...] = (1, 2, 3), text: str = "text") -> DataFrame:
    """How often, and up to which word, the mix takes each document.

    Returns doc_id, size, source_size, target, epochs (whole copies), taken (words, copies counted). A source's budget is
    its target without fraction: every document is taken as often as whole epochs fit, and one further, partial epoch in
    key order ends exactly at the budget, inside a document if need be. Nulls: a null text has size 0 and a null source is
    a source of its own, a null doc_id an id like any other. Repeated rows are separate documents; their order among
    themselves doesn't show. Sources without words have target 0. Very long texts are counted whole; further columns are
    ignored. An empty table gives an empty plan. Keys are MD5 digests of doc_id, so reruns agree.
    """
    taken = (F.col("epochs") * F.col("size") + _part()).cast("long")
    return _placed(documents, weights, text).select("doc_id", "size", "source_size", "target", "epochs", taken.alias("taken"))


def _bounds(documents: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """A row a source: its name (src), epochs, and the key, id and size at which the partial epoch ends (null: it takes nothing), and the words of rows with these three that it doesn't take (over)."""
    p = _placed(documents, weights, "text")
    rest = F.col("budget") - F.col("epochs") * F.col("source_size")
    last = F.when((F.col("start") < rest) & (rest <= F.col("start") + F.col("size")), F.struct("key", F.col("doc_id").alias("id"), "size", (F.col("end") - rest).alias("over")))
    return p.groupBy(F.col("source").alias("src")).agg(F.max("epochs").alias("epochs"), F.max(last).alias("last"))


def mixed_documents(documents: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """The mix itself, with the columns of documents: each row as often as its plan says.

    Of each source only its number of epochs and the place where the partial one ends are worked out, from ids and sizes;
    rows compare themselves with these, so texts are not shuffled. The document in which a source's budget ends gives its
    first words up to there, with their spaces, and, where there is a column n_chars, that part's number of characters.
    Documents without words have no share in a budget and stay as they are, once. Rows that agree in key, id and size with
    the last one are dealt out in the order of their other columns (which so can't be maps). Nulls, repeated rows, long
    texts and empty tables: as for mix_plan. Further columns are carried, whatever their names.
    """
    columns = documents.columns
    clear = unused("mix_", columns)
    at = lambda c: F.col(f"{clear}{c}")
    bounds = stash(_bounds(documents, weights), "bounds").select(*[F.col(c).alias(f"{clear}{c}") for c in ("src", "epochs", "last")])
    d = documents.withColumns({f"{clear}key": F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), f"{clear}size": n_words(F.col("text"))})
    d = d.join(small(bounds), F.col("source").eqNullSafe(at("src")))
    last, id_ = at("last"), F.col("doc_id")
    here = (at("key") == last["key"]) & id_.eqNullSafe(last["id"]) & (at("size") == last["size"])
    # nulls first, as in the order of the plan
    id_before = F.when(id_.isNull(), last["id"].isNotNull()).otherwise(F.coalesce(id_ < last["id"], F.lit(False)))
    before = (at("key") < last["key"]) | ((at("key") == last["key"]) & (id_before | (id_.eqNullSafe(last["id"]) & (at("size") < last["size"]))))
    copies = F.when(at("size") == 0, 1).when(last.isNull(), at("epochs")).otherwise(at("epochs") + before.cast("long"))
    row = F.struct(*[F.col(c) for c in columns])
    whole = d.where((at("size") == 0) | last.isNull() | ~here).select(F.explode(F.array_repeat(row, copies.cast("int"))).alias("r")).select("r.*")
    # the few rows with the last one's key, id and size: equal ones as one row with their number
    tied = d.where((at("size") > 0) & last.isNotNull() & here).select(at("src"), at("epochs"), last["size"].alias(f"{clear}size"), last["over"].alias(f"{clear}over"), row.alias(f"{clear}row"))
    tied = tied.groupBy(*tied.columns).agg(F.count(F.lit(1)).alias(f"{clear}n"))
    order = Window.partitionBy(f"{clear}src").orderBy(f"{clear}row")
    words = at("n") * at("size")
    tied = tied.withColumns({f"{clear}all": F.sum(words).over(Window.partitionBy(f"{clear}src")), f"{clear}start": F.sum(words).over(order) - words})
    part = F.greatest(F.lit(0), F.least(words, at("all") - at("over") - at("start")))
    tied = stash(tied.select(f"{clear}row", (at("epochs") * at("n") + F.floor(part / at("size"))).cast("int").alias(f"{clear}whole"), (part % at("size")).cast("int").alias(f"{clear}rest")), "tied")
    again = tied.select(F.explode(F.array_repeat(f"{clear}row", at("whole"))).alias("r")).select("r.*")
    cut = tied.where(at("rest") > 0).select(f"{clear}row.*", f"{clear}rest")
    words = F.regexp_extract_all("text", F.lit("[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+"), F.lit(0))
    cut = cut.withColumn("text", F.array_join(F.slice(words, F.lit(1), at("rest")), ""))
    if "n_chars" in columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
    return whole.unionByName(again).unionByName(cut.select(*columns))
