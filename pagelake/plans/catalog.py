"""Catalog queries: nation plays lists, customer items, orders photos."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.operators import catalog as C
from pagelake.plans.registry import query, read

_LISTS = "lists AS (SELECT n_nationkey AS list_id, CASE WHEN n_nationkey = 24 THEN 20 ELSE (n_nationkey * 7 + 3) % 25 END AS parent_list_id FROM nation)"
_BELOW = f"{_LISTS}, sub(list_id) AS (SELECT 5 UNION SELECT l.list_id FROM lists l JOIN sub ON l.parent_list_id = sub.list_id)"
_TRASH = "trash AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 20 <> 0 THEN 'x' END AS deleted FROM customer WHERE c_custkey % 10 = 0)"


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    return read(spark, sf_dir, "nation").select(k.alias("list_id"), F.when(k == 24, 20).otherwise((k * 7 + 3) % 25).alias("parent_list_id"))


def _catalog(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    c, o, k = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders"), F.col("c_custkey")
    return {
        "items": c.select(k.alias("id")),
        "trash": c.where(k % 10 == 0).select(k.alias("id"), F.when(k % 20 != 0, "x").alias("deleted")),
        "list_items": c.select(F.col("c_nationkey").alias("list_id"), k.alias("id"), F.when(k % 7 == 0, "x").alias("deleted")),
        "tags": c.select("c_mktsegment").distinct().select(F.crc32(F.col("c_mktsegment").cast("binary")).alias("tag_id"), F.initcap("c_mktsegment").alias("name")),
        "taggings": c.select(k.alias("id"), F.crc32(F.col("c_mktsegment").cast("binary")).alias("tag_id")),
        "values": c.where(k % 3 == 0).select(k.alias("id"), F.lit(C.TITLE_PROPERTIES[0]).alias("property"), F.when(k % 9 == 0, "  ").otherwise(F.concat(F.lit("  Title "), k, F.lit(" "))).alias("text")).union(c.where(k % 6 == 0).select(k.alias("id"), F.lit(C.TITLE_PROPERTIES[1]), F.concat(F.lit("Second "), k))),
        "photos": o.select(F.col("o_custkey").alias("item_id"), F.col("o_orderkey").alias("photo_id"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey") % 3).alias("position"), F.concat(F.lit("Box\\scan."), "o_orderkey", F.lit(".jpg")).alias("path"), F.when(F.col("o_orderkey") % 4 == 0, "named").alias("filename"), (F.col("o_orderkey") % 6 == 0).alias("missing")),
    }


@query(f"WITH RECURSIVE {_BELOW} SELECT list_id FROM sub")
def descendants_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = _lists(spark, sf_dir)
    return C.descendants(l, l.where("list_id = 5"))


@query(f"WITH RECURSIVE {_BELOW}, {_TRASH} SELECT c_custkey AS id FROM customer JOIN sub ON c_nationkey = list_id LEFT JOIN trash ON trash.id = c_custkey WHERE c_custkey % 7 <> 0 AND trash.deleted IS NULL")
def items_by_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, l = _catalog(spark, sf_dir), _lists(spark, sf_dir)
    return C.items_by_list(c["items"], c["list_items"], l, c["trash"], l.where("list_id = 5"))


@query(f"WITH {_TRASH} SELECT c_custkey AS id FROM customer LEFT JOIN trash ON trash.id = c_custkey WHERE c_mktsegment = 'BUILDING' AND trash.deleted IS NULL")
def items_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _catalog(spark, sf_dir)
    return C.items_by_tag(c["items"], c["taggings"], c["tags"], c["trash"], "bUILDING")


@query(f"WITH {_TRASH} SELECT c_custkey AS id FROM customer LEFT JOIN trash ON trash.id = c_custkey WHERE trash.deleted IS NULL")
def items_not_trashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _catalog(spark, sf_dir)
    return C.not_trashed(c["items"], c["trash"])


@query("""WITH f AS (SELECT o_custkey AS id, arg_min(CASE WHEN o_orderkey % 4 = 0 THEN 'named' ELSE '' END, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 3 ELSE -1 END * 100000000 + o_orderkey) AS file FROM orders GROUP BY o_custkey)
SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 9 <> 0 THEN 'Title ' || c_custkey ELSE coalesce(nullif(file, ''), 'Item ' || c_custkey) END AS title FROM customer LEFT JOIN f ON f.id = c_custkey""")
def title_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _catalog(spark, sf_dir)
    return C.titles(c["items"], c["values"], c["photos"])


@query("SELECT c_custkey AS id, coalesce(string_agg(o_orderkey || ':' || (o_orderkey % 6 = 0), ',' ORDER BY o_orderkey), '') AS photos, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def photos_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _catalog(spark, sf_dir)
    n = C.nested_photos(c["items"], c["photos"].select("item_id", "photo_id", "missing"))
    return n.select("id", F.array_join(F.transform("photos", lambda p: F.concat(p["photo_id"].cast("string"), F.lit(":"), p["missing"].cast("string"))), ",").alias("photos"), F.size("photos").cast("long").alias("n"))


@query("SELECT c_mktsegment AS tag, count(o_orderkey) AS photos, count(*) FILTER (o_orderkey % 6 = 0) AS missing, count(DISTINCT c_custkey) AS items FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_mktsegment")
def missing_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos are counted by item before the join, so items need no distinct count."""
    c = _catalog(spark, sf_dir)
    p = c["photos"].groupBy(F.col("item_id").alias("c_custkey")).agg(F.count(F.lit(1)).alias("p"), F.count_if("missing").alias("m"))
    j = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("tag")).join(p, "c_custkey", "left")
    return j.groupBy("tag").agg(F.coalesce(F.sum("p"), F.lit(0)).alias("photos"), F.coalesce(F.sum("m"), F.lit(0)).alias("missing"), F.count(F.lit(1)).alias("items"))


@query(f"WITH {_LISTS} SELECT list_id, parent_list_id FROM lists WHERE list_id <> 0 ORDER BY list_id")
def catalog_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.lists_of(_lists(spark, sf_dir))


_PATHS = ("/etc/passwd.jpg", "/etcetera/a.jpg", "C:\\Windows\\x.png", "c:/users/x.PNG", "/home/user/.ssh/k.jpg", "/home/user/pics/k.tiff", "/data/a.gif", "//server/a.jpg", "rel/a.jpg", "/data/../etc/a.jpg", "/data/x/../y.pdf", "/home/user/AppData/a.jpg")
_STATUS = ("protected_root", "ok", "protected_root", "ok", "protected_home", "ok", "file_type", "unc", "relative", "protected_root", "ok", "protected_home")


@query(f"WITH v AS (SELECT {list(_STATUS)} AS s) SELECT p_partkey, s[CAST(p_partkey % 12 AS INTEGER) + 1] AS status FROM part, v")
def path_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.array(*[F.lit(p) for p in _PATHS])
    return read(spark, sf_dir, "part").select("p_partkey", C.path_status(F.element_at(raw, (F.col("p_partkey") % 12).cast("int") + 1)).alias("status"))


@query("""SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN '/db' WHEN 1 THEN '/db' WHEN 2 THEN '/home/user' WHEN 3 THEN '/abs' ELSE '/db/sub' END || '/KV/' || s_suppkey || '.pdf' AS path FROM supplier""")
def photo_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey") % 5
    base = F.when(k == 1, "project").when(k == 2, "home").when(k == 3, "/abs/x/..").when(k == 4, "sub")
    return read(spark, sf_dir, "supplier").select("s_suppkey", C.photo_path(F.concat(F.lit(".\\KV\\"), "s_suppkey", F.lit(".pdf")), base, F.lit("/db"), "/home/user").alias("path"))


@query("SELECT upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) AS name, count(*) AS n FROM customer GROUP BY c_mktsegment")
def tag_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tags, and how many taggings each has."""
    c = _catalog(spark, sf_dir)
    n = c["taggings"].groupBy("tag_id").agg(F.count(F.lit(1)).alias("n"))
    return C.tags_of(c["tags"]).join(n, "tag_id").select("name", "n")
