"""Queries of small values: paths, prompts, records, shares, numbers, stage texts and times, each from what a table has."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.functions import geometry as G
from pagelake.functions import image as I
from pagelake.functions import text as T
from pagelake.operators import catalog as C
from pagelake.operators import collect as X
from pagelake.operators import history as H
from pagelake.operators import pages as P
from pagelake.plans.export import _PLAN, _plan
from pagelake.plans.images import _files
from pagelake.plans.registry import query, read
from pagelake.sinks import tables as B
from pagelake.sinks.pagexml import to_page_xml
from pagelake.sources import pagexml

_q = lambda text: "'" + text.replace("'", "''") + "'"


@query("""WITH o AS (SELECT o_orderkey, '/data/' || o_orderpriority || '/c' || o_custkey AS folder, '/data/' || o_orderstatus AS other FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN folder || '/x.jpg' ELSE other || '/x.jpg' END AS path, o_orderkey % 2 = 0 OR starts_with(other || '/x.jpg', folder || '/') AS inside FROM o""")
def contained_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that go up and down again, and whether they end below a customer's folder."""
    o, even = read(spark, sf_dir, "orders"), F.col("o_orderkey") % 2 == 0
    folder = F.concat(F.lit("/data/"), "o_orderpriority", F.lit("/c"), "o_custkey")
    path = F.when(even, F.concat(folder, F.lit("/./y/../x.jpg"))).otherwise(F.concat(folder, F.lit("/../../"), "o_orderstatus", F.lit("//x.jpg")))
    return o.select("o_orderkey", C.normal_path(path).alias("path"), C.contained(path, F.concat(folder, F.lit("/"))).alias("inside"))


_HINTED = " ".join(f"WHEN {_q(k)} THEN {_q(P.HINTS[k])}" for k in P.DOCUMENT_TYPES)


@query(f"""WITH k AS (SELECT CASE WHEN source IN ({", ".join(_q(k) for k in P.DOCUMENT_TYPES)}) THEN source ELSE [{", ".join(_q(k) for k in P.DOCUMENT_TYPES)}, 'unheard of', NULL][1 + CAST(length(text) % {len(P.DOCUMENT_TYPES) + 2} AS INTEGER)] END AS kind FROM documents)
SELECT kind, count(*) AS n, md5({_q(P.INSTRUCTION)} || CASE kind {_HINTED} ELSE {_q(P.HINTS["default"])} END) AS prompt_md5 FROM k GROUP BY kind""")
def prompts_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = [*P.DOCUMENT_TYPES, "unheard of", None]
    chosen = F.get(F.array(*map(F.lit, kinds)), (F.length("text") % len(kinds)).cast("int"))
    d = read(spark, sf_dir, "documents").select(F.when(F.col("source").isin(*P.DOCUMENT_TYPES), F.col("source")).otherwise(chosen).alias("kind"))
    return d.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select("kind", "n", F.md5(P.prompt_of(F.col("kind"))).alias("prompt_md5"))


@query("""SELECT p_partkey, '{' || array_to_string(list_filter(['"brand":"' || p_brand || '"', CASE WHEN p_size > 10 THEN '"model":"' || replace(p_name, '"', '\\"') || '"' END, '"size":"' || p_size || '"', CASE WHEN p_size % 2 = 0 THEN '"type":"' || p_type || '"' END], lambda x: x IS NOT NULL), ',') || '}' AS record FROM part""")
def provenance_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of how a part was made, without what is null or empty, keys in order."""
    size = F.col("p_size")
    fields = {"type": F.when(size % 2 == 0, F.col("p_type")), "model": F.when(size > 10, F.col("p_name")).otherwise(""), "brand": F.col("p_brand"), "size": size}
    return read(spark, sf_dir, "part").select("p_partkey", B.provenance(fields).alias("record"))


@query("SELECT CAST(CAST(round_even(l_discount::DOUBLE / 2 * 100, 0) AS BIGINT) AS VARCHAR) || '%' AS share, count(*) AS n FROM lineitem GROUP BY 1")
def percent_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of each discount as whole per cent; halves go to the even number."""
    return read(spark, sf_dir, "lineitem").groupBy(P.percent(F.col("l_discount").cast("double") / 2).alias("share")).agg(F.count(F.lit(1)).alias("n"))


_RAW = "CASE WHEN l_linenumber = 2 THEN 'x' || l_partkey WHEN l_linenumber = 3 THEN '' WHEN l_linenumber = 4 THEN CAST(-l_partkey AS STRING) ELSE CAST(l_partkey - 100 AS STRING) END"


@query("SELECT l_partkey, l_linenumber, count(*) AS n, CASE WHEN l_linenumber IN (2, 3, 4) OR l_partkey <= 100 THEN NULL ELSE CAST(l_partkey - 100 AS INTEGER) END AS number FROM lineitem GROUP BY l_partkey, l_linenumber")
def natural_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings that have to be natural numbers, from texts that often aren't."""
    d = read(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))
    return d.select("l_partkey", "l_linenumber", "n", T.positive_int(F.expr(_RAW)).alias("number"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, 'raw ' || l_partkey AS raw, CASE WHEN l_linenumber % 2 = 0 THEN 'new ' || l_suppkey ELSE 'old' END AS cleaned, NULL::VARCHAR AS translated, CAST(2 AS INTEGER) AS n FROM lineitem""")
def stage_texts_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of a line by stage, read, replaced and added."""
    one = lambda stage, text: F.struct(F.lit(G.STAGE_INDEX[stage]).alias("index"), text.alias("unicode"))
    raw = one("raw", F.concat(F.lit("raw "), "l_partkey"))
    even = F.col("l_linenumber") % 2 == 0
    e = read(spark, sf_dir, "lineitem").withColumn("e", F.when(even, F.array(raw)).otherwise(F.array(one("cleaned", F.lit("old")), raw)))
    e = e.withColumn("e", F.when(even, G.with_stage_text(F.col("e"), "cleaned", F.concat(F.lit("new "), "l_suppkey"))).otherwise(G.with_stage_text(F.col("e"), "cleaned", F.lit("old"))))
    return e.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", *[G.stage_text(F.col("e"), s).alias(s) for s in ("raw", "cleaned", "translated")], F.size("e").alias("n"))


_PAGE = "struct<image_filename:string,image_width:int,image_height:int,creator:string,created:timestamp,last_change:timestamp,steps:array<struct<name:string,value:string,date:timestamp>>,regions:array<struct<id:string,type:string,custom:string,polygon:array<struct<x:int,y:int>>,confidence:double,equivs:array<struct<index:int,unicode:string>>,lines:array<struct<id:string,polygon:array<struct<x:int,y:int>>,baseline:array<struct<x:int,y:int>>,equivs:array<struct<index:int,unicode:string>>>>>>,reading_order:array<string>,group_id:string,pc_gts_id:string>"


@query("SELECT user_id, CAST(count(*) AS BIGINT) AS n, epoch_us(min(ts)) AS created_us, epoch_us(max(ts)) AS changed_us FROM events GROUP BY user_id")
def page_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of a page document, to the microsecond, written as XML in UTC and read back: a document for each user."""
    e = read(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    none = lambda kind: F.array().cast(kind)
    kinds = dict(zip(("steps", "regions"), (x.split(":", 1)[1] for x in ("steps:array<struct<name:string,value:string,date:timestamp>>", "regions:" + _PAGE.split("regions:", 1)[1].split(",reading_order")[0])), strict=True))
    page = F.struct(F.lit("p.jpg"), F.lit(10), F.lit(10), F.lit("pagelake"), F.col("first").cast("timestamp"), F.col("last").cast("timestamp"), none(kinds["steps"]), none(kinds["regions"]), none("array<string>"), F.lit("order"), F.lit(None).cast("string")).cast(_PAGE)
    back = pagexml.parse(e.select(F.col("user_id").alias("id"), to_page_xml(page).cast("string").alias("xml")))
    return back.join(e.select(F.col("user_id").alias("id"), "n"), "id").select(F.col("id").alias("user_id"), "n", F.unix_micros("page.created").alias("created_us"), F.unix_micros("page.last_change").alias("changed_us"))


@query("""SELECT CAST(p_partkey AS BIGINT) AS p_partkey, CASE WHEN p_size % 6 < 4 THEN '0,0 ' || w || ',0 ' || w || ',' || h || ' 0,' || h END AS outline FROM (SELECT *, CASE WHEN p_size % 6 > 0 AND p_size % 9 BETWEEN 5 AND 8 THEN b ELSE a END AS w, CASE WHEN p_size % 6 > 0 AND p_size % 9 BETWEEN 5 AND 8 THEN a ELSE b END AS h FROM (SELECT *, p_partkey % 60000 + 1 AS a, (2 * p_partkey + p_size) % 60000 + 1 AS b FROM part))""")
def implicit_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one region of a page that isn't segmented: all of its image as it stands upright, by the size in the image's head."""
    made = read(spark, sf_dir, "part").selectExpr("CAST(p_partkey AS BIGINT) AS p_partkey", "p_size").mapInPandas(_files, "p_partkey bigint, content binary")
    s = made.select("p_partkey", I.image_sizes("content").alias("s"))
    outline = P.full_page(F.col("s.upright_width"), F.col("s.upright_height"))
    return s.select("p_partkey", F.when(outline.isNotNull(), F.array_join(F.transform(outline, lambda p: F.concat_ws(",", p["x"], p["y"])), " ")).alias("outline"))


@query("""SELECT o_orderkey, '{"ocr":{"state":"done","elapsed":' || CAST(round(o_totalprice::DOUBLE / 7, 3) AS VARCHAR) || ',"chars":' || o_custkey || ',"error":""},"translate":{"state":"failed","elapsed":0.0,"chars":0,"error":"' || o_orderpriority || '"}}' AS stage_json FROM orders""")
def stage_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a finished item's stages did, as the JSON that its history keeps."""
    s = lambda state, elapsed, chars, error: F.struct(F.lit(state).alias("state"), elapsed.alias("elapsed"), chars.cast("long").alias("chars"), error.alias("error"))
    m = F.create_map(F.lit("ocr"), s("done", F.col("o_totalprice").cast("double") / 7, F.col("o_custkey"), F.lit("")), F.lit("translate"), s("failed", F.lit(0.0), F.lit(0), F.col("o_orderpriority")))
    return read(spark, sf_dir, "orders").select("o_orderkey", H.stage_record(m).alias("stage_json"))


@query(f"""WITH {_PLAN}, c AS (SELECT action, count(*) AS n FROM a GROUP BY action)
SELECT k AS action, coalesce(n, 0) AS n FROM (SELECT unnest([{", ".join(_q(x) for x in X.ACTIONS)}]) AS k) LEFT JOIN c ON action = k UNION ALL SELECT 'ineligible', (SELECT count(*) FROM orders) UNION ALL SELECT 'selected', (SELECT count(*) FROM a) + (SELECT count(*) FROM orders)""")
def note_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a plan whose selection had an ineligible result for each order besides."""
    plan = _plan(spark, sf_dir)
    return X.plan_counts(plan, plan.count() + read(spark, sf_dir, "orders").count())
