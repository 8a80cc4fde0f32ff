"""Order and duplicates: stems, queues, edits, titles, sections, regions.

Every order ends with an ordinal that the caller carries from the scan, as Spark's rows have none of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def discriminator(checksum: Column, photo_id: Column, path: Column) -> Column:
    """Ten characters of the checksum, else the photo's id, else ten of the path's SHA-1, else 'dup'."""
    return F.coalesce(F.left(F.nullif(checksum, F.lit("")), F.lit(10)), F.concat(F.lit("id"), photo_id.cast("string")), F.left(F.sha1(F.nullif(path, F.lit("")).cast("binary")), F.lit(10)), F.lit("dup"))


def disambiguate(df: DataFrame, stem: str, suffix: Column, order: str) -> DataFrame:
    """The first row of a stem keeps it, later ones get __suffix. Partitions by stem only."""
    nth = F.row_number().over(Window.partitionBy(stem).orderBy(order))
    return df.withColumn("_nth", nth).withColumn(stem, F.when(F.col("_nth") > 1, F.concat_ws("__", stem, suffix)).otherwise(F.col(stem))).drop("_nth")


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key, by an aggregate that combines before the shuffle instead of a sort of all rows."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_row")).select(*keys, "_row.*")


def edit_history(edits: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """key, original, latest, n_edits: the text before its first real change, if any, and the newest one.

    edits: the first row of a key is the recorded text, later rows are edits. An empty text is never an original.
    """
    turn = Window.partitionBy(key).orderBy(order)
    e = edits.withColumn("_before", F.lag(text).over(turn)).withColumn("_n", F.row_number().over(turn))
    changed = (F.col("_n") > 1) & (F.coalesce("_before", F.lit("")) != "") & (F.col("_before") != F.col(text))
    return e.groupBy(key).agg(F.min_by(F.when(changed, F.col("_before")), F.when(changed, F.col("_n"))).alias("original"), F.max_by(text, order).alias("latest"), (F.count(F.lit(1)) - 1).alias("n_edits"))


def fill_title(df: DataFrame, key: str, title: str, order: str) -> DataFrame:
    """Rows without a title get the first one of their key."""
    first = F.first(F.nullif(F.col(title), F.lit("")), ignorenulls=True).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.withColumn(title, F.coalesce(F.nullif(F.col(title), F.lit("")), first))


def section_header(section: Column, window: Window) -> Column:
    """The section if it isn't empty and differs from the last one that wasn't."""
    named = F.nullif(section, F.lit(""))
    before = F.last(named, ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, -1))
    return F.when(named.isNotNull() & ~named.eqNullSafe(before), named)


def region_order(df: DataFrame, page: str, given: str, min_y: str, min_x: str, ordinal: str) -> Column:
    """Place (from 0) in a page: by given order if every region has one, then top to bottom and left to right."""
    whole = F.bool_and(F.col(given).isNotNull()).over(Window.partitionBy(page))
    df = df.withColumn("_given", F.when(whole, F.col(given)))
    return df.withColumn("place", F.row_number().over(Window.partitionBy(page).orderBy("_given", min_y, min_x, ordinal)) - 1).drop("_given")


def resolved_order(listed: Column, ids: Column) -> Column:
    """Listed ids that exist, then the others in document order."""
    return F.concat(F.filter(F.array_distinct(listed), lambda x: F.array_contains(ids, x)), F.filter(ids, lambda x: ~F.array_contains(listed, x)))


def assign_ids(ids: Column, prefix: str = "region") -> Column:
    """Unique ids in order: one's own if it isn't blank, else prefix-NNNN; a taken one gets the first free number.

    A fold, as an id given to one region can be the wish of a later one.
    """
    wish = F.transform(ids, lambda x, i: F.when(F.trim(F.coalesce(x, F.lit(""))) != "", F.trim(x)).otherwise(F.concat(F.lit(prefix + "-"), F.lpad((i + 1).cast("string"), 4, "0"))))

    def free(taken: Column, want: Column) -> Column:
        numbered = F.transform(F.sequence(F.lit(1), F.size(taken) + 1), lambda k: F.concat_ws("-", want, k.cast("string")))
        return F.element_at(F.filter(F.concat(F.array(want), numbered), lambda x: ~F.array_contains(taken, x)), 1)

    return F.aggregate(wish, F.array().cast("array<string>"), lambda taken, want: F.concat(taken, F.array(free(taken, want))))


def same_members(a: Column, b: Column) -> Column:
    """Whether b is an exact permutation of a."""
    return (F.size(a) == F.size(b)) & (F.array_sort(a) == F.array_sort(b))


def move(ids: Column, what: Column, target: Column, after: bool = False) -> Column:
    """ids with one element put before or after another; unchanged if either is missing."""
    rest = F.filter(ids, lambda x: x != what)
    at = F.array_position(rest, target).cast("int") + (1 if after else 0)
    ok = F.array_contains(ids, what) & F.array_contains(rest, target)
    return F.when(ok, F.array_insert(rest, at, what)).otherwise(ids)
