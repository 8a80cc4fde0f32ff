"""Queries of sources and sinks: what is written to the shared folder is read back. Benchmark passages and parts play files."""

from __future__ import annotations

import sqlite3
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.plans.registry import query, read
from pagelake.sinks import layout as L
from pagelake.sinks import tables as B
from pagelake.sinks.pagexml import page_xml
from pagelake.sources import files as A
from pagelake.sources import jsonld as J
from pagelake.sources import pagexml as P
from pagelake.sources import projects as H
from pagelake.sources import sqlite as Q
from pagelake.store import shared_dir


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/pagelake-{name}-{uuid.uuid4().hex}"


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark")


@query("SELECT 'box/' || item_id AS stem, md5(text) AS text_md5 FROM benchmark")
def stage_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "stage-files")
    B.write_files(_passages(spark, sf_dir).select(F.concat(F.lit("box/"), "item_id").alias("stem"), "text"), folder)
    return A.stage_texts(spark, folder).select("stem", F.md5("text").alias("text_md5"))


@query("SELECT CASE WHEN length(text) > 500 THEN 'cleaned' ELSE 'raw_ocr' END AS stage, doc_id, md5(text) AS text_md5 FROM documents")
def stage_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, stage = _folder(spark, "stage-tables"), F.when(F.length("text") > 500, "cleaned").otherwise("raw_ocr")
    B.write_stage(read(spark, sf_dir, "documents").select("doc_id", "text", stage.alias("stage")), folder)
    return spark.read.parquet(folder).select("stage", "doc_id", F.md5("text").alias("text_md5"))


@query("SELECT CAST(item_id AS VARCHAR) AS stem, strlen(text) AS n_bytes FROM benchmark WHERE item_id % 4 IN (0, 1)")
def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All passages are written, with four file types, two of them pages."""
    folder, k = _folder(spark, "page-files"), F.col("item_id") % 4
    suffix = F.when(k == 0, ".JPG").when(k == 1, ".pdf").when(k == 2, ".gif").otherwise(".txt")
    B.write_files(_passages(spark, sf_dir).select(F.concat(F.lit("Box 1/"), "item_id", suffix).alias("stem"), "text"), folder, "")
    return A.pages(spark, folder, recursive=True).select("stem", F.col("length").alias("n_bytes"))


@query("SELECT CAST(item_id AS VARCHAR) AS stem, CASE WHEN item_id % 5 <> 0 THEN 'raw_ocr' END AS stage, CASE WHEN item_id % 5 <> 0 THEN CAST(item_id AS INTEGER) END AS page, item_id % 5 = 0 AS corrupt FROM benchmark")
def sidecar_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "sidecars")
    record = F.to_json(F.struct(F.lit("raw_ocr").alias("stage"), F.col("item_id").alias("page"), F.col("text").alias("extracted_text")))
    B.write_files(_passages(spark, sf_dir).select(F.col("item_id").cast("string").alias("stem"), F.when(F.col("item_id") % 5 == 0, "{broken").otherwise(record).alias("text")), folder, ".json")
    good, bad = A.sidecars(spark, folder)
    broken = bad.select(A.stem_of(F.col("path")).alias("stem"), F.lit(None).cast("string").alias("stage"), F.lit(None).cast("int").alias("page"), F.lit(True).alias("corrupt"))
    return good.select("stem", "stage", "page", F.lit(False).alias("corrupt")).unionByName(broken)


@query("SELECT 'p' || p_partkey AS key, '{\"page_number\":' || p_size || '}' AS entry FROM part")
def manifest_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = F.concat(F.lit('{"page_number":'), "p_size", F.lit("}"))
    whole = B.manifest_json(read(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("stem"), entry.alias("entry")), "e.json", F.lit("2026-01-01T00:00:00+00:00"))
    return A.manifest(whole, "manifest").select("key", "entry")


@query("SELECT CAST(p_partkey AS VARCHAR) AS stem, CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 2 = 0 THEN p_partkey || '.jpg' ELSE p_partkey || '.png' END AS image FROM part")
def truth_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("stem"), "p_size")
    some = p.where("p_size % 3 <> 0")
    images = some.select("stem", F.concat("stem", F.lit(".png")).alias("path")).union(some.where("p_size % 2 = 0").select("stem", F.concat("stem", F.lit(".jpg"))))
    found, lost = A.accuracy_pairs(images, p.select("stem"))
    return found.select("stem", "image").unionByName(lost.select("stem", F.lit(None).cast("string").alias("image")))


@query("SELECT o_orderkey, 'scan' || o_custkey || CASE WHEN n > 0 THEN '_' || n ELSE '' END || '.jpg' AS saved_as, CASE WHEN o_totalprice > 200000 THEN 'too_large' ELSE 'ok' END AS status FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 + CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) THEN 1 ELSE 0 END AS n FROM orders)")
def upload_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda c: F.concat(F.lit("scan"), c, F.lit(".jpg")).alias("name")
    files = read(spark, sf_dir, "orders").select("o_orderkey", name("o_custkey"), F.when(F.col("o_totalprice") > 200000, A.UPLOAD_BYTES + 1).otherwise(1).alias("length"))
    taken = read(spark, sf_dir, "customer").where("c_acctbal > 0").select(name("c_custkey"))
    return A.uploads(files, taken, "o_orderkey").select("o_orderkey", "saved_as", "status")


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation WHERE n_regionkey > 0")
def sqlite_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A database of the nations, a table of fixed size, in a folder: found there, read in parts, the filter in the database."""
    folder = _folder(spark, "sqlite").removeprefix("file:")
    Path(folder).mkdir(parents=True)
    c = sqlite3.connect(f"{folder}/{Q.PROJECT}")
    c.execute("CREATE TABLE nation (n_nationkey INTEGER, n_name TEXT, n_regionkey INTEGER)")
    c.executemany("INSERT INTO nation VALUES (?, ?, ?)", [tuple(r) for r in read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").collect()])
    c.commit()
    c.close()
    return Q.table(spark, folder, "nation", 4).where("n_regionkey > 0")


def _exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, key = F.col("p_partkey") % 5, F.col("p_partkey").cast("string")
    put = lambda t: F.replace(F.lit(t), F.lit("#K#"), key)
    text = (
        F.when(k == 0, put('{"@type":"Item","title":" Box #K# ","photo":[{"path":"a\\\\b#K#.jpg","checksum":"c#K#"}]}'))
        .when(k == 1, put('{"@graph":[{"@type":"Template"},{"@type":["x#Item"],"photo":{"path":"/data/#K#.png","page":2}}]}'))
        .when(k == 2, put('{"@type":"Item","dc:title":"T#K#","photo":[7,{"path":"../#K#.jpg"},{"path":"#K#.pdf","mimetype":"application/pdf"}]}'))
        .when(k == 3, F.lit("[" * 40 + "]" * 40)).otherwise(put('{"broken": #K#'))
    )
    return read(spark, sf_dir, "part").select(key.alias("path"), F.lit("/exports").alias("folder"), text.alias("text"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS path, CASE p_partkey % 5 WHEN 3 THEN 'too deep' WHEN 4 THEN 'no JSON' END AS error FROM part")
def export_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exports(spark, sf_dir).select("path", J.json_budget("text")["error"].alias("error"))


@query("""WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS path, p_partkey % 5 AS k FROM part)
SELECT path, 0 AS idx, 'Box ' || path AS title, 0 AS photo_index, '/exports/a/b' || path || '.jpg' AS resolved, 'c' || path AS checksum, CAST(NULL AS INTEGER) AS page, 'ok' AS status FROM p WHERE k = 0
UNION ALL SELECT path, 1, 'Item 2', 0, '/data/' || path || '.png', '', 2, 'ok' FROM p WHERE k = 1
UNION ALL SELECT path, 0, 'T' || path, 0, NULL, '', NULL, 'not_object' FROM p WHERE k = 2
UNION ALL SELECT path, 0, 'T' || path, 1, NULL, '', NULL, 'escapes' FROM p WHERE k = 2
UNION ALL SELECT path, 0, 'T' || path, 2, '/exports/' || path || '.pdf', '', 0, 'ok' FROM p WHERE k = 2""")
def export_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = J.photos(J.items(_exports(spark, sf_dir)))
    return p.select("path", "idx", "title", "photo_index", F.when(F.col("status") == "ok", F.col("resolved")).alias("resolved"), "checksum", "page", "status")


_PAGE = "struct<image_filename:string,image_width:int,image_height:int,creator:string,created:timestamp,last_change:timestamp,steps:array<struct<name:string,value:string,date:timestamp>>,regions:array<struct<id:string,type:string,custom:string,polygon:array<struct<x:int,y:int>>,confidence:double,equivs:array<struct<index:int,unicode:string>>,lines:array<struct<id:string,polygon:array<struct<x:int,y:int>>,baseline:array<struct<x:int,y:int>>,equivs:array<struct<index:int,unicode:string>>>>>>,reading_order:array<string>,group_id:string,pc_gts_id:string>"


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS pos FROM lineitem)
SELECT l_orderkey AS page, CAST(NULL AS VARCHAR) AS error, string_agg('a' || l_partkey || ' & <b>', chr(10) || chr(10) ORDER BY pos DESC) AS text, CAST(count(*) AS INTEGER) AS regions, min(pos || ',' || CAST(l_quantity AS INTEGER)) AS first_point FROM l GROUP BY 1""")
def page_xml_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as XML and parsed again: texts of a stage in reading order, and the regions' points."""
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    l = read(spark, sf_dir, "lineitem").select("l_orderkey", pos.alias("pos"), F.concat(F.lit("a"), "l_partkey", F.lit(" & <b>")).alias("t"), F.col("l_quantity").cast("int").alias("q"))
    point, null = F.array(F.struct(F.col("pos").alias("x"), F.col("q").alias("y"))), F.lit(None)
    equivs = F.array(F.struct(F.lit(1).alias("index"), F.lit("two").alias("unicode")), F.struct(F.lit(0).alias("index"), F.col("t").alias("unicode")))
    region = F.struct(F.concat(F.lit("r"), "pos").alias("id"), F.lit("other").alias("type"), F.lit("").alias("custom"), point.alias("polygon"), F.lit(0.5).alias("confidence"), equivs.alias("equivs"), F.array().cast("array<struct<id:string,polygon:array<struct<x:int,y:int>>,baseline:array<struct<x:int,y:int>>,equivs:array<struct<index:int,unicode:string>>>>").alias("lines"))
    g = l.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("pos", region.alias("r")))).alias("r"))
    when = F.lit("2026-01-02 03:04:05").cast("timestamp")
    page = F.struct(F.lit("p.jpg"), F.lit(997), F.lit(613), F.lit("pagelake"), when, when, F.array().cast("array<struct<name:string,value:string,date:timestamp>>"), F.col("r.r"), F.reverse(F.col("r.r.id")), F.lit("order"), null.cast("string")).cast(_PAGE)
    back = P.parse(g.select(F.col("l_orderkey").alias("id"), page.alias("p")).select("id", page_xml(F.col("p"), T._parse_datatype_string(_PAGE)).cast("string").alias("xml")))
    first = F.array_min(F.transform("page.regions", lambda r: F.concat_ws(",", r["polygon"][0]["x"], r["polygon"][0]["y"])))
    return back.select("id", "error", P.page_text(F.col("page"), 0).alias("text"), F.size("page.regions").alias("regions"), first.alias("first_point")).withColumnRenamed("id", "page")


@query("SELECT 's' || item_id AS slug, CASE WHEN item_id % 3 = 0 THEN 'Project ' || item_id ELSE 's' || item_id END AS name FROM benchmark")
def project_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of three projects one has a name, one a broken file, one none; files below a project don't name it."""
    root, k = _folder(spark, "projects"), F.col("item_id") % 3
    b = _passages(spark, sf_dir).select(F.concat(F.lit("projects/s"), "item_id", F.when(k == 2, "/pipeline/x").otherwise("/project.json")).alias("stem"), F.when(k == 0, F.concat(F.lit('{"name": "Project '), "item_id", F.lit('"}'))).otherwise("{broken").alias("text"), "item_id")
    B.write_files(b, root, "")
    B.write_files(b.select(F.concat(F.lit("projects/s"), "item_id", F.lit("/exports/project.json")).alias("stem"), F.lit('{"name": "inner"}').alias("text")), root, "")
    return H.projects(spark, root).select("slug", "name")


@query("""SELECT md5(CAST(item_id AS VARCHAR)) AS token, CASE WHEN item_id % 5 <> 0 THEN CASE item_id % 5 WHEN 1 THEN 'stranger' ELSE 'reader' END END AS source,
CASE item_id % 5 WHEN 0 THEN 'broken' WHEN 1 THEN 'unknown' WHEN 2 THEN 'expired' ELSE 'ok' END AS status, CASE item_id % 5 WHEN 3 THEN md5(text) END AS body_md5 FROM benchmark""")
def handed_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of every manifest, and the texts that reach the writer; those for the editor don't."""
    folder, k, token = _folder(spark, "handovers"), F.col("item_id") % 5, F.md5(F.col("item_id").cast("string"))
    created = F.when(k == 2, "2026-01-01T10:00:00+00:00").otherwise("2026-01-01T11:30:00+00:00")
    m = F.to_json(F.struct(F.lit(1).alias("version"), F.when(k == 1, "stranger").otherwise("reader").alias("source"), F.when(k == 4, "editor").otherwise("writer").alias("target"), created.alias("created"), F.concat(token, F.lit(".txt")).alias("body_file")))
    b = _passages(spark, sf_dir).select(token.alias("stem"), "text", F.when(k == 0, "no json").otherwise(m).alias("m"))
    B.write_files(b, folder)
    B.write_files(b.select("stem", F.col("m").alias("text")), folder, ".json")
    manifests, bodies = H.handovers(spark, folder)
    now, known = F.lit("2026-01-01 12:00:00+00:00").cast("timestamp"), ("reader", "writer", "editor")
    got = H.received(manifests, bodies, "writer", now, known).select("token", F.md5("body").alias("body_md5"))
    return H.judged_handovers(manifests, now, known).select("token", "source", "status").join(got, "token", "left")


@query("""SELECT 'brand-' || lower(replace(p_brand, '#', '')) AS slug, 'Brand ' || upper(left(replace(p_brand, '#', ''), 1)) || lower(substr(replace(p_brand, '#', ''), 2)) AS name, count(*) AS runs, min(p_partkey) AS first_part FROM part GROUP BY p_brand""")
def created_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A project for each brand, made twice, and a run for each of its parts; read back from the folders."""
    root = _folder(spark, "layout")
    slug = F.concat(F.lit("brand-"), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))))
    parts = read(spark, sf_dir, "part").select(slug.alias("slug"), F.to_json(F.struct(F.col("p_partkey").alias("part"))).alias("metadata"))
    for r in parts.select("slug").distinct().collect():  # a driver makes projects, tasks their runs
        for _ in range(2):
            L.Project(spark, root, r["slug"]).ensure()
    L.create_runs(spark, root, parts)
    said = H.runs(spark, root).select("slug", F.get_json_object("value", "$.run_id").alias("run_id"), F.get_json_object("value", "$.part").cast("long").alias("part"))
    said = said.groupBy("slug").agg(F.countDistinct("run_id").alias("runs"), F.min("part").alias("first_part"))
    return H.projects(spark, root).select("slug", "name").join(said, "slug")


@query("""SELECT CAST(p_partkey AS VARCHAR) AS path, CASE WHEN p_size % 7 = 0 THEN NULL ELSE md5('{"brand":"' || p_brand || '","list":[1,' || p_size || ',{"b":null,"ä":"ü"}],"size":' || p_partkey || '}') END AS canonical_md5, CASE WHEN p_size % 7 = 0 THEN NULL ELSE CAST(2 AS INTEGER) END AS depth, CASE WHEN p_size % 7 = 0 THEN 'no JSON' END AS error FROM part""")
def canonical_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with their keys in another order, and broken ones: canonical form, depth and error."""
    p, key = read(spark, sf_dir, "part"), F.col("p_partkey").cast("string")
    text = F.concat(F.lit('{ "size" : '), key, F.lit(', "list": [1 , '), "p_size", F.lit(', {"b":null, "\\u00e4":"ü"}],\n"brand":"'), "p_brand", F.when(F.col("p_size") % 7 == 0, '"').otherwise('"}'))
    b = J.json_budget("text")
    return p.select(key.alias("path"), text.alias("text")).select("path", F.md5(J.canonical_json("text")).alias("canonical_md5"), F.when(b["error"].isNull(), b["depth"]).alias("depth"), b["error"].alias("error"))
