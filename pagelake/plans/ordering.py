"""Queries on order and duplicates, on the driver's tables in the roles of items, edits, pages and regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelake.functions import geometry as G
from pagelake.functions.text import natural_key
from pagelake.operators import ordering as O
from pagelake.plans.registry import query, read


@query("""WITH s AS (SELECT o_orderkey, 'Box ' || (o_custkey % 40) || '/scan' AS stem, CASE o_orderkey % 3 WHEN 0 THEN md5(CAST(o_orderkey AS VARCHAR)) WHEN 1 THEN '' END AS checksum, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS photo_id FROM orders),
n AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY o_orderkey) AS nth FROM s)
SELECT o_orderkey, stem || CASE WHEN nth > 1 THEN '__' || coalesce(left(nullif(checksum, ''), 10), 'id' || photo_id, left(sha1(stem), 10)) ELSE '' END AS stem FROM n""")
def disambiguate_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("Box "), F.col("o_custkey") % 40, F.lit("/scan")).alias("stem"), F.when(k % 3 == 0, F.md5(k.cast("string"))).when(k % 3 == 1, "").alias("c"), F.when(k % 2 == 0, F.col("o_custkey")).alias("p"))
    o = o.withColumn("d", O.discriminator(F.col("c"), F.col("p"), F.col("stem")))
    return O.disambiguate(o, "stem", F.col("d"), "o_orderkey").select("o_orderkey", "stem")


@query("SELECT user_id, event_type, arg_min(event_id, event_id) AS event_id, arg_min(value, event_id) AS value FROM events GROUP BY ALL")
def queue_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return O.keep_first(e.withColumn("ord", F.col("event_id")), ["user_id", "event_type"], "ord").drop("ord")


@query("""WITH e AS (SELECT user_id, event_id, CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type END AS text, row_number() OVER w AS n, lag(CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type END) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, arg_min(before, n) FILTER (n > 1 AND coalesce(before, '') <> '' AND before <> text) AS original, arg_max(text, event_id) AS latest, count(*) - 1 AS n_edits FROM e GROUP BY user_id""")
def first_edit_original(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_id") % 5 == 0, "").otherwise(F.col("event_type")).alias("text"))
    return O.edit_history(e, "user_id", "text", "event_id")


_PAGES = "p AS (SELECT l_orderkey AS book, (l_linenumber * 1000000 + l_partkey) * 10000 + l_suppkey AS page, CASE WHEN (l_partkey + l_linenumber) % 3 = 0 THEN 'T' || l_partkey ELSE '' END AS title, CASE WHEN l_returnflag <> 'N' THEN l_returnflag ELSE '' END AS section, l_partkey, l_suppkey FROM lineitem)"


def _book_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("book"), ((F.col("l_linenumber") * 1000000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")).alias("page"), F.when((F.col("l_partkey") + F.col("l_linenumber")) % 3 == 0, F.concat(F.lit("T"), "l_partkey")).otherwise("").alias("title"),
        F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).otherwise("").alias("section"), "l_partkey", "l_suppkey",
    )


@query(f"WITH {_PAGES} SELECT book, page, coalesce(nullif(title, ''), first_value(nullif(title, '') IGNORE NULLS) OVER (PARTITION BY book ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS title FROM p")
def fill_item_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.fill_title(_book_pages(spark, sf_dir), "book", "title", "page").select("book", "page", "title")


@query(f"""WITH {_PAGES}, b AS (SELECT *, last_value(nullif(section, '') IGNORE NULLS) OVER (PARTITION BY book ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM p)
SELECT book, page, CASE WHEN section <> '' AND section IS DISTINCT FROM before THEN section END AS header FROM b""")
def section_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("book").orderBy("page")
    return _book_pages(spark, sf_dir).select("book", "page", O.section_header(F.col("section"), w).alias("header"))


@query(r"""WITH n AS (SELECT p_partkey, p_brand, 'Page' || (p_partkey * 7 % 1009) || CASE WHEN p_partkey % 2 = 0 THEN 'b' ELSE 'B10' END AS name FROM part),
k AS (SELECT *, list_transform(regexp_extract_all(lower(name), '\d+|[^\d]+'), lambda x: CASE WHEN regexp_matches(x, '^\d') THEN lpad(x, 20, '0') ELSE x END) AS key FROM n)
SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY array_to_string(key, chr(1)), p_partkey) AS place FROM k""")
def natural_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("Page"), F.col("p_partkey") * 7 % 1009, F.when(F.col("p_partkey") % 2 == 0, "b").otherwise("B10"))
    p = read(spark, sf_dir, "part").select("p_partkey", "p_brand", natural_key(name).alias("key"))
    return p.select("p_partkey", "p_brand", F.row_number().over(Window.partitionBy("p_brand").orderBy("key", "p_partkey")).cast("long").alias("place"))


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_linenumber % 3 <> 0 THEN l_partkey END NULLS LAST, l_linenumber) AS place FROM lineitem")
def page_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.when(F.col("l_linenumber") % 3 != 0, F.col("l_partkey"))
    w = Window.partitionBy("l_orderkey").orderBy(number.asc_nulls_last(), "l_linenumber")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(w).cast("long").alias("place"))


_REGIONS = "r AS (SELECT l_orderkey AS page, l_linenumber AS n, CASE WHEN l_orderkey % 2 = 0 OR l_linenumber > 1 THEN l_partkey % 4 END AS given, CAST(l_quantity AS INTEGER) % 10 AS y, CAST(l_suppkey % 5 AS INTEGER) AS x FROM lineitem)"


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_orderkey")
    return read(spark, sf_dir, "lineitem").select(
        k.alias("page"), F.col("l_linenumber").alias("n"), F.when((k % 2 == 0) | (F.col("l_linenumber") > 1), F.col("l_partkey") % 4).alias("given"),
        (F.col("l_quantity").cast("int") % 10).alias("y"), (F.col("l_suppkey") % 5).cast("int").alias("x"),
    )


@query(f"""WITH {_REGIONS}, g AS (SELECT *, CASE WHEN bool_and(given IS NOT NULL) OVER (PARTITION BY page) THEN given END AS o FROM r)
SELECT page, n, row_number() OVER (PARTITION BY page ORDER BY o NULLS FIRST, y, x, n) - 1 AS place FROM g""")
def region_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.region_order(_regions(spark, sf_dir), "page", "given", "y", "x", "n").select("page", "n", F.col("place").cast("long").alias("place"))


@query(f"""WITH {_REGIONS}, i AS (SELECT page, list(CAST(n AS VARCHAR) ORDER BY n) AS ids, list(CAST(x * 2 AS VARCHAR) ORDER BY y, n, x) AS raw FROM r GROUP BY page),
d AS (SELECT page, ids, list_filter(raw, lambda v, k: list_position(raw, v) = k) AS listed FROM i)
SELECT page, array_to_string(list_concat(list_filter(listed, lambda v: list_contains(ids, v)), list_filter(ids, lambda v: NOT list_contains(listed, v))), ',') AS reading_order FROM d""")
def resolved_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _regions(spark, sf_dir).groupBy("page").agg(
        F.transform(F.array_sort(F.collect_list("n")), lambda v: v.cast("string")).alias("ids"),
        F.transform(F.array_sort(F.collect_list(F.struct("y", "n", "x"))), lambda v: (v["x"] * 2).cast("string")).alias("listed"),
    )
    return r.select("page", F.array_join(O.resolved_order(F.col("listed"), F.col("ids")), ",").alias("reading_order"))


@query(f"""WITH RECURSIVE {_REGIONS}, w AS (SELECT page, list(CASE WHEN x = 0 THEN 'region-' || lpad(CAST(i AS VARCHAR), 4, '0') WHEN x = 1 THEN 'region-0002' ELSE 'r' || (y % 3) END ORDER BY i) AS wish FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY n, CASE WHEN x = 0 THEN ' ' WHEN x = 1 THEN 'region-0002' ELSE 'r' || (y % 3) END) AS i FROM r) GROUP BY page),
f AS (SELECT page, wish, 1 AS i, [wish[1]] AS ids FROM w
UNION ALL SELECT page, wish, i + 1, list_append(ids, CASE WHEN list_contains(ids, wish[i + 1]) THEN wish[i + 1] || '-' || list_filter(range(1, i + 2), lambda k: NOT list_contains(ids, wish[i + 1] || '-' || k))[1] ELSE wish[i + 1] END) FROM f WHERE i < len(wish))
SELECT page, array_to_string(ids, ',') AS ids FROM f WHERE i = len(wish)""")
def region_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unique ids in order; tests hold the fold against a loop."""
    wish = F.when(F.col("x") == 0, " ").when(F.col("x") == 1, "region-0002").otherwise(F.concat(F.lit("r"), F.col("y") % 3))
    r = _regions(spark, sf_dir).select("page", "n", wish.alias("wish")).groupBy("page").agg(F.array_sort(F.collect_list(F.struct("n", "wish"))).alias("w"))
    return r.select("page", F.array_join(O.assign_ids(F.col("w.wish")), ",").alias("ids"))


@query("""WITH l AS (SELECT l_orderkey AS page, l_suppkey % 3 AS region, l_linenumber - 1 AS pos FROM lineitem WHERE l_suppkey % 4 <> 0),
f AS (SELECT page, region, min(pos) AS first, count(*) AS n_lines FROM l GROUP BY ALL),
r AS (SELECT DISTINCT l_orderkey AS page, region FROM lineitem, (VALUES (0), (1), (2), (9)) v(region)),
k AS (SELECT r.page, r.region, coalesce(n_lines, 0) AS n_lines, coalesce(first, count(first) OVER (PARTITION BY r.page)) AS key FROM r LEFT JOIN f USING (page, region))
SELECT page, region, n_lines, row_number() OVER (PARTITION BY page ORDER BY key, region) - 1 AS place FROM k""")
def line_region_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions by their first line; one without lines sorts by how many have some, so it may come before others."""
    l = read(spark, sf_dir, "lineitem")
    first = l.where("l_suppkey % 4 <> 0").groupBy(F.col("l_orderkey").alias("page"), (F.col("l_suppkey") % 3).alias("region")).agg(F.min(F.col("l_linenumber") - 1).alias("first"), F.count(F.lit(1)).alias("n_lines"))
    r = l.select(F.col("l_orderkey").alias("page")).distinct().withColumn("region", F.explode(F.array(*[F.lit(x).cast("long") for x in (0, 1, 2, 9)])))
    k = r.join(first, ["page", "region"], "left").withColumn("key", F.coalesce("first", F.count("first").over(Window.partitionBy("page"))))
    place = F.row_number().over(Window.partitionBy("page").orderBy("key", "region")) - 1
    return k.select("page", F.col("region").cast("int").alias("region"), F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"), place.cast("long").alias("place"))


@query("""WITH i AS (SELECT l_orderkey AS page, list(l_linenumber ORDER BY l_linenumber) AS a, list(CASE WHEN l_orderkey % 3 = 0 THEN l_linenumber WHEN l_orderkey % 3 = 1 THEN 1 ELSE l_linenumber END ORDER BY l_linenumber DESC) AS b FROM lineitem GROUP BY l_orderkey)
SELECT page, len(a) = len(b) AND list_sort(a) = list_sort(b) AS accepted FROM i""")
def reorder_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.when(F.col("l_orderkey") % 3 == 1, 1).otherwise(F.col("l_linenumber"))
    g = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("page")).agg(F.collect_list("l_linenumber").alias("a"), F.collect_list(b).alias("b"))
    return g.select("page", O.same_members(F.col("a"), F.col("b")).alias("accepted"))


@query("""WITH i AS (SELECT l_orderkey AS q, list_sort(list(DISTINCT l_linenumber)) AS a FROM lineitem GROUP BY l_orderkey)
SELECT q, array_to_string(list_concat([a[2]], [a[len(a)]], [a[1]], a[3:len(a) - 1]), ',') AS ids FROM i WHERE len(a) > 2""")
def queue_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last element moves before the first, then the first before all: two moves."""
    g = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("q")).agg(F.array_sort(F.collect_set("l_linenumber")).alias("a")).where("size(a) > 2")
    a = F.col("a")
    moved = O.move(O.move(a, F.element_at(a, -1), a[0]), a[1], F.element_at(a, -1))
    return g.select("q", F.array_join(moved, ",").alias("ids"))


_BOXES = "b AS (SELECT l_orderkey, l_linenumber, l_quantity / 3.0 AS x, l_extendedprice / 100.0 AS y, l_partkey % 700 + 1 AS w, l_suppkey % 300 + 1 AS h, l_discount * 200 AS deviation, l_linenumber % 2 = 0 AS ink FROM lineitem)"


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_quantity") / F.lit(3.0)).alias("x"), (F.col("l_extendedprice") / F.lit(100.0)).alias("y"), (F.col("l_partkey") % 700 + 1).alias("w"),
        (F.col("l_suppkey") % 300 + 1).alias("h"), (F.col("l_discount") * 200).alias("deviation"), (F.col("l_linenumber") % 2 == 0).alias("ink"),
    )


@query(f"""WITH {_BOXES} SELECT l_orderkey, l_linenumber, CAST(least(997, greatest(0, round_even(x * (997 / 640::DOUBLE), 0))) AS INTEGER) AS rx, CAST(least(613, greatest(0, round_even(y * (613 / 480::DOUBLE), 0))) AS INTEGER) AS ry FROM b""")
def rescale_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = G.restored(F.array(F.struct("x", "y")), F.lit(640), F.lit(480), F.lit(997), F.lit(613))
    return _boxes(spark, sf_dir).select("l_orderkey", "l_linenumber", p[0]["x"].alias("rx"), p[0]["y"].alias("ry"))


@query(f"""WITH {_BOXES}, c AS (SELECT l_orderkey, l_linenumber, CAST(trunc(x) AS INTEGER) AS x0, CAST(trunc(y) AS INTEGER) AS y0, CAST(trunc(x + w) AS INTEGER) AS x1, CAST(trunc(y + h) AS INTEGER) AS y1 FROM b),
p AS (SELECT *, CAST(round_even((x1 - x0) * 0.02::DOUBLE, 0) AS INTEGER) AS px, CAST(round_even((y1 - y0) * 0.02::DOUBLE, 0) AS INTEGER) AS py FROM c)
SELECT l_orderkey, l_linenumber, greatest(0, x0 - px) AS x0, greatest(0, y0 - py) AS y0, least(997, x1 + px) AS x1, least(613, y1 + py) AS y1 FROM p""")
def crop_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = F.array(F.struct("x", "y"), F.struct((F.col("x") + F.col("w")).alias("x"), (F.col("y") + F.col("h")).alias("y")))
    return _boxes(spark, sf_dir).select("l_orderkey", "l_linenumber", G.crop_bounds(points, 0.02, F.lit(997), F.lit(613)).alias("c")).select("l_orderkey", "l_linenumber", "c.*")


@query(f"""WITH {_BOXES}, t AS (SELECT *, CAST(trunc(x) AS INTEGER) AS cx, CAST(trunc(y) AS INTEGER) AS cy FROM b)
SELECT l_orderkey, l_linenumber, CASE WHEN h BETWEEN 2 AND 12 AND w / h::DOUBLE >= 5.0 AND deviation <= 20.0 AND ink THEN 'underline' WHEN cx < 3 OR cx > 14 OR cy < 100 OR cy > 500 THEN 'marginalia' ELSE 'unclassified' END AS kind FROM t""")
def classify_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.struct(F.lit(3).alias("x0"), F.lit(100).alias("y0"), F.lit(14).alias("x1"), F.lit(500).alias("y1"))
    c = F.col
    kind = G.component_type(c("w"), c("h"), c("deviation"), c("x").cast("int"), c("y").cast("int"), c("ink"), text)
    return _boxes(spark, sf_dir).select("l_orderkey", "l_linenumber", kind.alias("kind"))


@query(f"""WITH {_BOXES} SELECT l_orderkey, CAST(min(CAST(trunc(x) AS INTEGER)) AS INTEGER) AS x0, CAST(min(CAST(trunc(y) AS INTEGER)) AS INTEGER) AS y0, CAST(max(CAST(trunc(x) AS INTEGER)) AS INTEGER) AS x1, CAST(max(CAST(trunc(y) AS INTEGER)) AS INTEGER) AS y1, count(*) AS n_regions FROM b GROUP BY l_orderkey""")
def bounding_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = F.collect_list(F.struct(F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y")))
    g = _boxes(spark, sf_dir).groupBy("l_orderkey").agg(points.alias("p"))
    return g.select("l_orderkey", G.bbox(F.col("p")).alias("b"), F.size("p").cast("long").alias("n_regions")).select("l_orderkey", "b.*", "n_regions")


@query("""WITH d AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 3 = 0 THEN 'marginalia' WHEN l_partkey % 3 = 1 THEN 'circling' ELSE 'text' END AS kind, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem)
SELECT l_orderkey, l_linenumber, 'diffres-' || lpad(CAST(n AS VARCHAR), 4, '0') AS id, CASE WHEN kind = 'marginalia' THEN kind ELSE 'other' END AS page_type, 'structure {type:' || CASE WHEN kind = 'text' THEN 'unclassified' ELSE kind END || ';}' AS custom FROM d""")
def detected_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_partkey") % 3 == 0, "marginalia").when(F.col("l_partkey") % 3 == 1, "circling").otherwise("text")
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", G.numbered("diffres", n).alias("id"), G.page_type(kind).alias("page_type"), G.custom_of(kind).alias("custom"))


@query("""WITH s AS (SELECT p_partkey, p_size * 40 AS w, CAST(floor(p_retailprice) AS INTEGER) AS h FROM part), c AS (SELECT *, 1288 / greatest(w, h)::DOUBLE AS f FROM s)
SELECT p_partkey, CASE WHEN f < 1 THEN greatest(1, CAST(round_even(w * f, 0) AS INTEGER)) ELSE w END AS w, CASE WHEN f < 1 THEN greatest(1, CAST(round_even(h * f, 0) AS INTEGER)) ELSE h END AS h FROM c""")
def fitted_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = F.col("p_size") * 40, F.floor("p_retailprice").cast("int")
    return read(spark, sf_dir, "part").select("p_partkey", G.fitted(w, h).alias("s")).select("p_partkey", "s.*")
