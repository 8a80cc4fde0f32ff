"""Export queries: manifests, two languages, Markdown, note plans."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.operators import collect as X
from pagelake.operators import export as E
from pagelake.plans.registry import query, read
from pagelake.sinks import notes as N
from pagelake.store import shared_dir


@query("""WITH m AS (SELECT 'Item ' || (o_custkey % 30) || '/page_' || (o_orderkey % 400) AS key, o_orderkey AS ord, o_orderkey AS entry FROM orders),
k AS (SELECT key, max(ord) AS ord, arg_max(entry, ord) AS entry FROM m GROUP BY key), s AS (SELECT string_split(key, '/')[-1] AS stem, arg_max(key, ord) AS key, arg_max(entry, ord) AS entry FROM k GROUP BY 1),
f AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'page_' || p_partkey ELSE 'Item ' || (p_partkey % 30) || '/page_' || (p_partkey % 400) END AS stem FROM part)
SELECT p_partkey, coalesce(k.key, s.key) AS matched_key, coalesce(k.entry, s.entry) AS entry FROM f LEFT JOIN s ON s.stem = f.stem LEFT JOIN k ON k.key = f.stem""")
def manifest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, p = F.col("o_orderkey"), F.col("p_partkey")
    m = read(spark, sf_dir, "orders").select(F.concat(F.lit("Item "), F.col("o_custkey") % 30, F.lit("/page_"), o % 400).alias("key"), o.alias("ord"))
    m = m.groupBy("key").agg(F.max("ord").alias("ord")).withColumn("entry", F.col("ord"))
    f = read(spark, sf_dir, "part").select("p_partkey", F.when(p % 2 == 0, F.concat(F.lit("page_"), p)).otherwise(F.concat(F.lit("Item "), p % 30, F.lit("/page_"), p % 400)).alias("stem"))
    return X.match_manifest(f, m).drop("stem")


@query("""WITH m AS (SELECT 'page_' || (o_orderkey % 400) AS stem, arg_min(o_orderkey, o_orderkey) AS entry FROM orders GROUP BY 1) SELECT * FROM m""")
def manifest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("o_orderkey")
    return X.first_entry(read(spark, sf_dir, "orders").select(F.concat(F.lit("Item/page_"), o % 400).alias("key"), o.alias("ord"), o.alias("entry")))


@query("""WITH old AS (SELECT 'p' || p_partkey AS stem, p_size AS entry FROM part WHERE p_partkey % 2 = 0), new AS (SELECT 'p' || p_partkey AS stem, -p_size AS entry FROM part WHERE p_partkey % 3 = 0)
SELECT coalesce(old.stem, new.stem) AS stem, coalesce(new.entry, old.entry) AS entry FROM old FULL JOIN new ON old.stem = new.stem""")
def manifest_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("stem"), "p_partkey", "p_size")
    return X.merge_manifest(p.where("p_partkey % 2 = 0").select("stem", F.col("p_size").alias("entry")), p.where("p_partkey % 3 = 0").select("stem", (-F.col("p_size")).alias("entry")))


#: Every conversation's first and second turn; two folders hold a file of each name, of which the last one counts.
_SIDES = """c AS (SELECT 'c' || conv_id AS label, coalesce(text, '') AS o FROM conversations WHERE turn = 0), t AS (SELECT 'c' || conv_id AS label, replace(coalesce(text, ''), '. ', '.' || chr(10) || chr(10)) AS t FROM conversations WHERE turn = 1)"""


def _sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = read(spark, sf_dir, "conversations").withColumn("folder", F.explode(F.array(F.lit("a"), F.lit("b"))))
    said = F.when(F.col("folder") == "b", F.coalesce("text", F.lit(""))).otherwise("an older version")
    k = k.select(F.concat_ws("/", "folder", F.concat(F.lit("c"), "conv_id", F.lit(".txt"))).alias("path"), said.alias("text"), "turn")
    return X.bilingual(k.where("turn = 0"), k.where("turn = 1").withColumn("text", F.replace("text", F.lit(". "), F.lit(".\n\n"))))


@query(f"WITH {_SIDES} SELECT label, o AS original_text, coalesce(t, '') AS translated_text FROM c LEFT JOIN t USING (label)")
def bilingual_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sides(spark, sf_dir)


_PARA = "list_filter(list_transform(string_split({}, chr(10) || chr(10)), lambda x: trim(x)), lambda x: x <> '')"


@query(f"""WITH {_SIDES}, p AS (SELECT label, {_PARA.format('o')} AS a, {_PARA.format("coalesce(t, '')")} AS b FROM c LEFT JOIN t USING (label))
SELECT label, CASE WHEN greatest(len(a), len(b)) = 0 THEN '' ELSE '| Original | Translation |' || chr(10) || '|---|---|' || chr(10) || array_to_string(list_transform(range(1, greatest(len(a), len(b)) + 1), lambda i: '| ' || replace(replace(coalesce(a[i], ''), '|', '\\|'), chr(10), ' ') || ' | ' || replace(replace(coalesce(b[i], ''), '|', '\\|'), chr(10), ' ') || ' |'), chr(10)) END AS markdown FROM p""")
def bilingual_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sides(spark, sf_dir).select("label", X.bilingual_table(F.col("original_text"), F.col("translated_text")).alias("markdown"))


@query("""WITH n AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, lag(role) OVER w AS before, row_number() OVER w AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, md5('# ' || conv_id || chr(10) || chr(10) || string_agg(CASE WHEN role IS DISTINCT FROM before THEN '## ' || role || chr(10) || chr(10) ELSE '' END || '### Page ' || n || chr(10) || chr(10) || '[t' || turn || ']' || chr(10) || chr(10) || text || chr(10), chr(10) ORDER BY n)) AS markdown_md5 FROM n GROUP BY conv_id""")
def markdown_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("t"), "turn").alias("label"), F.coalesce("text", F.lit("")).alias("text"), F.col("role").alias("section"))
    return X.markdown(p, "conv_id", ["turn"]).select("conv_id", F.md5("markdown").alias("markdown_md5"))


_PLAN = """e AS (SELECT l_orderkey * 10 + l_linenumber AS entry, l_partkey AS photo_id, CASE WHEN l_linenumber % 4 <> 0 THEN l_suppkey END AS item_id, CASE WHEN l_linenumber = 2 THEN '  ' ELSE 'note  ' || l_partkey END AS text, CASE WHEN l_linenumber = 3 THEN 'other' ELSE 'mine' END AS project FROM lineitem),
a AS (SELECT entry, CASE WHEN project <> 'mine' THEN 'foreign' WHEN trim(text) = '' THEN 'empty' WHEN photo_id % 10 = 0 THEN 'missing_photo' WHEN item_id IS NOT NULL AND item_id % 2 <> photo_id % 2 THEN 'item_mismatch' WHEN photo_id % 7 = 0 THEN 'duplicate' ELSE 'ready' END AS action FROM e)"""


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, n = read(spark, sf_dir, "lineitem"), F.col("l_linenumber")
    return l.select((F.col("l_orderkey") * 10 + n).alias("entry"), F.col("l_partkey").alias("photo_id"), F.when(n % 4 != 0, F.col("l_suppkey") % 2).alias("item_id"), F.when(n == 2, "  ").otherwise(F.concat(F.lit("note  "), "l_partkey")).alias("text"), F.when(n == 3, "other").otherwise("mine").alias("project"))


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, p = _entries(spark, sf_dir), read(spark, sf_dir, "part")
    photos = p.where("p_partkey % 10 <> 0").select(F.col("p_partkey").alias("photo_id"), (F.col("p_partkey") % 2).alias("item"))
    notes = p.where("p_partkey % 7 = 0").select(F.col("p_partkey").alias("photo_id"), F.concat(F.lit("note "), "p_partkey", F.lit("\n")).alias("text"))
    return X.note_plan(e, photos, notes, "mine")


@query(f"WITH {_PLAN} SELECT entry, action FROM a")
def note_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir).select("entry", "action")


@query(f"WITH {_PLAN} SELECT action, count(*) AS n FROM a GROUP BY action")
def note_plan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


_READY = _PLAN.replace("SELECT entry, CASE", "SELECT *, CASE")


@query(f"""WITH {_READY} SELECT photo_id, '<p>note  ' || photo_id || '</p>' AS html, 'note  ' || photo_id AS text, CASE WHEN photo_id % 2 = 0 THEN 'de' ELSE 'fr' END AS language FROM (SELECT DISTINCT photo_id FROM a WHERE action = 'ready')
UNION ALL SELECT photo_id, '<p>note ' || photo_id || '</p>', 'note ' || photo_id, 'en' FROM (SELECT p_partkey AS photo_id FROM part WHERE p_partkey % 7 = 0 AND p_partkey % 10 <> 0)""")
def committed_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store of notes after an earlier batch, a commit with the wrong count, which leaves nothing, the right one, and the same one once more."""
    path = f"{shared_dir(spark)}/pagelake-notes-{uuid.uuid4().hex}"
    p = read(spark, sf_dir, "part")
    photos = p.where("p_partkey % 10 <> 0").select(F.col("p_partkey").alias("photo_id"), (F.col("p_partkey") % 2).alias("item"))
    k = F.col("p_partkey")
    before = p.where("p_partkey % 7 = 0 and p_partkey % 10 <> 0").select(k.alias("photo_id"), F.lit(None).cast("long").alias("item_id"), F.concat(F.lit("note "), k, F.lit("\n")).alias("text"), F.lit("mine").alias("project"), F.lit("en").alias("language"))
    N.commit_notes(before, photos, path, "mine", before.count(), "first")
    entries = _entries(spark, sf_dir).withColumn("language", F.when(F.col("photo_id") % 2 == 0, "de").otherwise("fr"))
    ready = _plan(spark, sf_dir).where("action = 'ready'").count()
    for expected in (ready + 1, ready, ready):
        with contextlib.suppress(N.CountChanged):
            N.commit_notes(entries, photos, path, "mine", expected, "second")
    return N.committed(spark, path)


def _stage_texts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(stems by brand, texts): some parts have a cleaned text, some only a raw or a translated one, a blank one, or none."""
    p = read(spark, sf_dir, "part")
    stem, k = F.concat(F.lit("p"), "p_partkey"), F.col("p_partkey") % 5
    stems = p.select(F.col("p_brand").alias("batch"), F.col("p_partkey").alias("ord"), stem.alias("stem"), F.when(F.col("p_size") % 2 == 0, F.lit("Letters")).otherwise("").alias("item_title"))
    side = lambda stage, cond: p.where(cond).select(stem.alias("stem"), F.lit(stage).alias("stage"), F.when((k == 3) & (F.lit(stage) == "cleaned"), " ").otherwise(F.concat(F.lit(f"{stage} "), "p_partkey")).alias("text"))
    return stems, side("cleaned", k.isin(0, 3)).union(side("raw_ocr", k.isin(0, 1, 3))).union(side("translated", k.isin(1, 2)))


_CHOSEN = "b AS (SELECT p_brand AS batch, p_partkey AS k, 'p' || p_partkey AS stem, p_size % 2 = 0 AS titled, CASE p_partkey % 5 WHEN 0 THEN 'cleaned' WHEN 1 THEN 'raw_ocr' WHEN 2 THEN 'translated' WHEN 3 THEN 'raw_ocr' END AS stage FROM part)"


@query(f"WITH {_CHOSEN} SELECT stem, stage, stage || ' ' || k AS text FROM b")
def collected_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part, those without any text too."""
    found, lost = E.collected(*_stage_texts(spark, sf_dir))
    none = F.lit(None).cast("string")
    return found.select("stem", "stage", "text").unionByName(lost.select("stem", none.alias("stage"), none.alias("text")))


@query(f"""WITH {_CHOSEN}, p AS (SELECT *, row_number() OVER w AS n, lag(titled) OVER w AS before FROM b WHERE stage IS NOT NULL WINDOW w AS (PARTITION BY batch ORDER BY k)),
h AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY k) = min(CASE WHEN titled THEN n END) OVER (PARTITION BY batch) AS first FROM p),
g AS (SELECT batch, CASE WHEN bool_or(titled) THEN 'Letters' END AS title, string_agg(CASE WHEN first THEN '## Letters' || chr(10) || chr(10) ELSE '' END || '### Page ' || n || chr(10) || chr(10) || '[' || stem || ']' || chr(10) || chr(10) || stage || ' ' || k || chr(10), chr(10) ORDER BY k) AS body FROM h GROUP BY batch),
s AS (SELECT batch, count(*) FILTER (stage IS NULL) AS n_skipped FROM b GROUP BY batch)
SELECT batch, md5('# ' || coalesce(title, batch) || chr(10) || chr(10) || body) AS markdown_md5, n_skipped FROM g JOIN s USING (batch)""")
def export_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A book of each brand, and how many of its parts have no text."""
    books, lost = E.export_batches(*_stage_texts(spark, sf_dir))
    return books.join(lost, "batch", "left").select("batch", F.md5("markdown").alias("markdown_md5"), F.coalesce("n_skipped", F.lit(0)).alias("n_skipped"))


@query("SELECT 'Box: ' || p_brand || '/p' || p_partkey AS stem, CASE WHEN p_partkey % 3 <> 0 THEN 'Box_ ' || p_brand || '_p' || p_partkey || '.xml' END AS file FROM part")
def exported_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    stem = F.concat(F.lit("Box: "), "p_brand", F.lit("/p"), "p_partkey")
    p = read(spark, sf_dir, "part").select(stem.alias("stem"), "p_partkey")
    found, lost = E.page_documents(p.select("stem"), p.where("p_partkey % 3 <> 0").select("stem", F.lit("<x/>").alias("xml")))
    return found.select("stem", "file").unionByName(lost.select("stem", F.lit(None).cast("string").alias("file")))


@query("SELECT 'p' || p_partkey AS stem, CASE p_partkey % 4 WHEN 0 THEN '/out/box/text' WHEN 1 THEN '/out/box' WHEN 2 THEN '/out/box' END AS root, CASE p_partkey % 4 WHEN 0 THEN 'own' WHEN 1 THEN 'box' END AS page FROM part")
def nearest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents beside the texts, one or two folders up, unreadable ones (which end the search), and none."""
    stem, k = F.concat(F.lit("p"), "p_partkey").alias("stem"), F.col("p_partkey") % 4
    p = read(spark, sf_dir, "part")
    at = lambda root, page, cond: p.where(cond).select(F.lit(root).alias("root"), stem, F.lit(page).cast("string").alias("page"))
    documents = at("/out/box/text", "own", k == 0).union(at("/out/box", "box", k < 2)).union(at("/out/box", None, k == 2)).union(at("/out", "top", k.isin(1, 2))).union(at("/other", "x", k == 3))
    return E.nearest_document(p.select(F.lit("/out/box/text/").alias("folder"), stem), documents).select("stem", "root", "page")


@query("SELECT CAST(CASE WHEN n_nationkey % 2 = 0 THEN 0 ELSE 2 END AS INTEGER) AS place, '/data/' || n_name AS path FROM nation WHERE n_nationkey % 4 < 2")
def recent_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state text for each nation: lists with entries of other kinds, no lists, broken ones."""
    n, k = F.col("n_name"), F.col("n_nationkey") % 4
    path = F.concat(F.lit('"/data/'), n, F.lit('"'))
    text = F.when(k == 0, F.concat(F.lit('{"recent":['), path, F.lit(',"/gone"]}'))).when(k == 1, F.concat(F.lit('{"recent":[7,null,'), path, F.lit("]}"))).when(k == 2, F.concat(F.lit('{"recent":'), path, F.lit("}"))).otherwise("[")
    d = read(spark, sf_dir, "nation")
    return E.recent_projects(d.select(text.alias("text")), d.select(F.concat(F.lit("/data/"), n).alias("path")))


@query("""WITH o AS (SELECT o_custkey, list('Box ' || CASE WHEN o_custkey % 3 = 0 THEN o_custkey ELSE o_orderkey % 7 END || '/p') AS s, count(DISTINCT o_orderkey % 7) AS tops FROM orders GROUP BY 1)
SELECT o_custkey, CASE WHEN o_custkey % 5 = 0 THEN 'batch' WHEN o_custkey % 3 = 0 OR tops = 1 THEN s[1][:-3] ELSE 'batch' END || '-20260101-1200' AS batch_name, 'box-' || o_custkey || '_bilingual.md' AS folder_name FROM o""")
def export_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of batches, by the one folder all their pages lie in, and of a folder's two-language export."""
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    stem = F.when(c % 5 == 0, F.concat(F.lit("p"), k)).otherwise(F.concat(F.lit("Box "), F.when(c % 3 == 0, c).otherwise(k % 7), F.lit("/p")))
    o = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(stem).alias("s"))
    folder = F.concat(F.lit("/out/Box "), c, F.lit("/"))
    return o.select("o_custkey", X.batch_name(F.col("s"), F.lit("20260101-1200")).alias("batch_name"), E.default_name(folder, bilingual=True).alias("folder_name"))
