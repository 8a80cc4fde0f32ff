"""Catalog queries: list hierarchies, tags, trash, titles, photos, path rules. Tables as in the catalog's database."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.functions.text import stripped
from pagelake.store import stash

# Properties that hold a title, in order, and what photo paths may and may not be.
TITLE_PROPERTIES = ("http://purl.org/dc/elements/1.1/title", "http://purl.org/dc/terms/title")
MEDIA = (".jpg", ".jpeg", ".png", ".tif", ".tiff", ".pdf")
BLOCKED_POSIX = ("/etc", "/usr", "/bin", "/sbin", "/lib", "/lib64", "/var", "/sys", "/proc", "/dev", "/boot", "/root", "/run", "/private/etc", "/private/var")
BLOCKED_WINDOWS = ("c:/windows", "c:/program files", "c:/program files (x86)", "c:/programdata", "c:/$recycle.bin", "c:/system volume information")
BLOCKED_HOME = (".ssh", ".gnupg", ".aws", ".azure", ".kube", ".docker", "AppData")
LONGEST_PATH = 4096


def descendants(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """list_id of the roots and of all lists below them, once each; cycles end.

    Level by level: a frontier of new lists is joined with their children, known ones are left out, and each
    level is written, so depth costs jobs and a diamond costs nothing twice.
    """
    found = frontier = stash(roots.select("list_id").distinct(), "lists")
    while frontier.limit(1).count():
        below = lists.join(frontier.withColumnRenamed("list_id", "parent_list_id"), "parent_list_id", "left_semi").select("list_id").distinct()
        frontier = stash(below.join(found, "list_id", "left_anti"), "lists")
        found = found.union(frontier)
    return found


def not_trashed(items: DataFrame, trash: DataFrame) -> DataFrame:
    """Items without a deletion date in the trash; a trash row without one keeps its item, once for each such row."""
    t = trash.select(F.col("id").alias("_id"), F.col("deleted").alias("_deleted"))
    return items.join(t, F.col("id") == F.col("_id"), "left").where("_deleted is null").drop("_id", "_deleted")


def items_by_list(items: DataFrame, list_items: DataFrame, lists: DataFrame, trash: DataFrame, roots: DataFrame) -> DataFrame:
    inside = list_items.where("deleted is null").join(descendants(lists, roots), "list_id", "left_semi").select("id")
    return not_trashed(items.join(inside, "id", "left_semi"), trash).select("id").distinct()


def items_by_tag(items: DataFrame, taggings: DataFrame, tags: DataFrame, trash: DataFrame, tag: str) -> DataFrame:
    """Items with a tag of this name; case is folded for A to Z only."""
    fold = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    wanted = tags.where(fold(F.col("name")) == fold(F.lit(tag))).select("tag_id")
    return not_trashed(items.join(taggings.join(wanted, "tag_id").select("id"), "id"), trash)


def titles(items: DataFrame, values: DataFrame, photos: DataFrame) -> DataFrame:
    """id, title: from the metadata (by property if there are several), else the first photo's file name, else 'Item n'; stripped.

    A first value or photo that is blank counts as none; a later one doesn't take its place. One join a source instead of
    lookups for each item. values: id, property, text.
    """
    own = values.where(F.col("property").isin(*TITLE_PROPERTIES)).groupBy("id").agg(F.min_by("text", "property").alias("_own"))
    first = photos.groupBy(F.col("item_id").alias("id")).agg(F.min_by("filename", F.struct("position", "photo_id")).alias("_file"))
    known = lambda c: F.nullif(stripped(F.col(c)), F.lit(""))
    return items.join(own, "id", "left").join(first, "id", "left").select("id", F.coalesce(known("_own"), known("_file"), F.concat(F.lit("Item "), F.col("id").cast("string"))).alias("title"))


def nested_photos(items: DataFrame, photos: DataFrame) -> DataFrame:
    """id, photos: an array of structs in order of photo_id; empty for none."""
    p = photos.groupBy(F.col("item_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("photo_id", *[c for c in photos.columns if c not in ("item_id", "photo_id")]))).alias("photos"))
    kind = dict(p.dtypes)["photos"]
    return items.select("id").join(p, "id", "left").withColumn("photos", F.coalesce("photos", F.array().cast(kind)))


def lists_of(lists: DataFrame) -> DataFrame:
    return lists.where("list_id <> 0").orderBy("list_id")


def tags_of(tags: DataFrame) -> DataFrame:
    return tags.orderBy("tag_id")


def is_absolute(path: Column) -> Column:
    return path.startswith("/") | path.startswith("\\") | path.rlike(r"^[A-Za-z]:[/\\]")


def photo_path(path: Column, base: Column, folder: Column, home: str) -> Column:
    """A photo's path: below the project's folder, the home folder, an absolute base, or a base in the project's folder."""
    p = F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/"))
    b = F.coalesce(base, F.lit(""))
    root = F.when(b.isin("", "project"), folder).when(b == "home", F.lit(home)).when(is_absolute(b), b).otherwise(F.concat_ws("/", folder, b))
    return normal_path(F.when(is_absolute(p), p).otherwise(F.concat_ws("/", root, p)))


def normal_path(path: Column) -> Column:
    """Without empty and '.' segments, '..' taken back."""
    parts = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda a, x: F.when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x))))
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(kept, "/"))


def _below(parts: Column, root: str) -> Column:
    segments = [x for x in root.split("/") if x]
    return F.slice(parts, 1, len(segments)) == F.array(*[F.lit(x) for x in segments])


def path_status(path: Column, home: str = "/home/user") -> Column:
    """'ok' or why a photo's absolute path is refused: whole segments are compared, on Windows paths without case."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    windows = p.rlike(r"^[A-Za-z]:/")
    raw = F.filter(F.split(p, "/"), lambda x: ~x.isin("", "."))
    low, clean = F.transform(raw, F.lower), F.filter(F.split(normal_path(p), "/"), lambda x: x != "")
    any_of = lambda parts, roots: sum((F.when(_below(parts, r), 1).otherwise(0) for r in roots), F.lit(0)) > 0
    blocked = F.when(windows, any_of(low, BLOCKED_WINDOWS) | any_of(F.transform(clean, F.lower), BLOCKED_WINDOWS)).otherwise(any_of(raw, BLOCKED_POSIX) | any_of(clean, BLOCKED_POSIX))
    own = [x for x in home.split("/") if x]
    child = F.when(_below(clean, home), F.get(clean, F.lit(len(own))))
    suffix = F.regexp_extract(F.lower(F.element_at(F.split(p, "/"), -1)), r"[^.](\.[^.]*)$", 1)
    return (
        F.when(F.contains(path, F.lit("\0")), "null_byte").when(F.length(path) > LONGEST_PATH, "too_long").when(p.startswith("//"), "unc").when(~is_absolute(p), "relative")
        .when(blocked, "protected_root").when(F.coalesce(child.isin(*BLOCKED_HOME), F.lit(False)), "protected_home").when(~suffix.isin(*MEDIA), "file_type").otherwise("ok")
    )


def contained(path: Column, root: Column) -> Column:
    """Whether a path, dots resolved, is the root or below it."""
    a, b = normal_path(path), normal_path(root)
    return (a == b) | a.startswith(F.concat(b, F.lit("/")))
