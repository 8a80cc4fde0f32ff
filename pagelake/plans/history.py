"""Queries on run history: orders play runs, lineitem plays run items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.operators import history as H
from pagelake.operators import resume as R
from pagelake.plans.registry import query, read

_RUNS = "runs AS (SELECT o_orderkey AS run_id, CAST(o_orderdate AS VARCHAR) AS started, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END AS finished, o_orderpriority AS translate_model, o_custkey % 50 AS total, o_custkey % 7 AS failed, o_custkey * 0.25::DOUBLE AS elapsed, o_orderstatus AS doc_type FROM orders)"
_ITEMS = """items AS (SELECT l_orderkey * 10 + l_linenumber AS item_id, l_orderkey AS run_id, CASE l_linestatus WHEN 'O' THEN 'done' ELSE CASE WHEN l_partkey % 2 = 0 THEN 'failed' ELSE 'pending' END END AS state,
 CASE WHEN l_quantity > 5 THEN CAST(l_quantity AS INTEGER) * 2 END AS confidence, 'C:\\scans\\Box ' || (l_suppkey % 10) || '\\Page_' || l_partkey || '.JPG' AS source_file, 'Page ' || l_partkey || ' Straße' AS name,
 CASE WHEN l_shipdate > TIMESTAMP '1995-01-01' THEN 'raw ' || l_returnflag || ' text ' || l_partkey END AS raw_text, 'clean ' || l_linestatus || ' 50% of_it ' || l_suppkey AS cleaned_text, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_returnflag FROM lineitem)"""


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("started"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate")).alias("finished"), F.col("o_orderpriority").alias("translate_model"),
        (F.col("o_custkey") % 50).alias("total"), (F.col("o_custkey") % 7).alias("failed"), (F.col("o_custkey") * F.lit(0.25)).alias("elapsed"), F.col("o_orderstatus").alias("doc_type"), F.lit("model-a").alias("ocr_model"),
    )


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return read(spark, sf_dir, "lineitem").select(
        (c("l_orderkey") * 10 + c("l_linenumber")).alias("item_id"), c("l_orderkey").alias("run_id"), F.when(c("l_linestatus") == "O", "done").when(c("l_partkey") % 2 == 0, "failed").otherwise("pending").alias("state"),
        F.when(c("l_quantity") > 5, c("l_quantity").cast("int") * 2).alias("confidence"), F.concat(F.lit("C:\\scans\\Box "), c("l_suppkey") % 10, F.lit("\\Page_"), "l_partkey", F.lit(".JPG")).alias("source_file"),
        F.concat(F.lit("Page "), "l_partkey", F.lit(" Straße")).alias("name"), F.when(c("l_shipdate") > F.lit("1995-01-01").cast("timestamp"), F.concat(F.lit("raw "), "l_returnflag", F.lit(" text "), "l_partkey")).alias("raw_text"),
        F.concat(F.lit("clean "), "l_linestatus", F.lit(" 50% of_it "), "l_suppkey").alias("cleaned_text"), F.lit(None).cast("string").alias("translated_text"), (c("l_partkey") % 9 == 0).cast("int").alias("fabricated_result"),
        "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag",
    )


@query(f"WITH {_RUNS} SELECT count(*) AS runs, CAST(coalesce(sum(total), 0) AS BIGINT) AS files, CAST(coalesce(sum(failed), 0) AS BIGINT) AS failed, round(coalesce(sum(elapsed), 0), 2) AS elapsed FROM runs")
def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.run_totals(_runs(spark, sf_dir)).withColumn("elapsed", F.round("elapsed", 2))


@query(f"WITH {_RUNS}, {_ITEMS} SELECT translate_model AS model, sum(confidence) / count(*) AS avg_conf, count(*) AS n FROM items JOIN runs USING (run_id) WHERE confidence IS NOT NULL GROUP BY translate_model")
def by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.by_model(_items(spark, sf_dir), _runs(spark, sf_dir))


@query(f"""WITH {_ITEMS}, s AS (SELECT 'raw_ocr' AS stage, CASE WHEN l_returnflag = 'R' THEN 'failed' ELSE 'done' END AS state, l_partkey AS chars, l_quantity * 0.25::DOUBLE AS elapsed, item_id FROM items UNION ALL SELECT 'cleaned', state, CAST(floor(l_extendedprice) AS BIGINT), 0.5, item_id FROM items)
SELECT stage, CAST(sum(chars) AS BIGINT) AS chars, round(sum(elapsed), 2) AS elapsed, count(*) AS n FROM s WHERE state = 'done' AND item_id % 13 <> 0 GROUP BY stage""")
def stage_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages as JSON texts, every 13th corrupt."""
    stage = lambda state, chars, elapsed: F.struct(state.alias("state"), elapsed.alias("elapsed"), chars.cast("long").alias("chars"))
    s = F.to_json(F.struct(stage(F.when(F.col("l_returnflag") == "R", "failed").otherwise("done"), F.col("l_partkey"), F.col("l_quantity") * F.lit(0.25)).alias("raw_ocr"), stage(F.col("state"), F.floor("l_extendedprice"), F.lit(0.5)).alias("cleaned")))
    i = _items(spark, sf_dir).select(F.when(F.col("item_id") % 13 == 0, "{broken").otherwise(s).alias("stage_json"))
    return H.stage_throughput(i).withColumn("elapsed", F.round("elapsed", 2))


@query(f"WITH {_RUNS} SELECT run_id, started, total, failed, elapsed FROM runs WHERE finished IS NOT NULL ORDER BY run_id DESC LIMIT 20")
def recent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.recent_runs(_runs(spark, sf_dir))


@query(f"WITH {_ITEMS} SELECT item_id, confidence FROM items WHERE confidence IS NOT NULL")
def confidence_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.confidences(_items(spark, sf_dir))


@query(f"WITH {_ITEMS} SELECT run_id, count(*) FILTER (state = 'done') AS done, count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (l_partkey % 4 = 0) AS reused FROM items GROUP BY run_id")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    skip = F.create_map(F.lit("raw_ocr"), F.when(F.col("l_partkey") % 4 == 0, "already_exists").otherwise("not_selected"))
    return H.run_summary(_items(spark, sf_dir).withColumn("skip", skip))


_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(f"WITH {_ITEMS} SELECT item_id, name, state, confidence FROM items WHERE {_FOLD.format('name')} LIKE '%page_12%' OR {_FOLD.format('source_file')} LIKE '%page_12%' ORDER BY item_id DESC LIMIT 200")
def search_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.search(_items(spark, sf_dir), "PAGE_12").select("item_id", "name", "state", "confidence")


@query(f"WITH {_ITEMS} SELECT item_id, name, source_file, raw_text, cleaned_text FROM items WHERE coalesce({_FOLD.format('raw_text')} LIKE '%r text 1%', false) OR {_FOLD.format('cleaned_text')} LIKE '%r text 1%' ORDER BY item_id LIMIT 200")
def fulltext_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.fulltext(_items(spark, sf_dir), "R Text 1").select("item_id", "name", "source_file", "raw_text", "cleaned_text")


@query(f"WITH {_ITEMS} SELECT item_id FROM items WHERE false")
def blank_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.search(_items(spark, sf_dir), "  ").select("item_id")


@query(f"WITH {_RUNS}, {_ITEMS} SELECT 1 AS schema_version, item_id, run_id, 'Page_' || l_partkey || '.JPG' AS source_file, started AS run_started, doc_type, 'model-a' AS configured_ocr_model FROM items JOIN runs USING (run_id) WHERE l_partkey % 9 = 0")
def label_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.labels(_items(spark, sf_dir), _runs(spark, sf_dir))


@query("SELECT doc_id FROM documents WHERE lang = 'en' AND NOT coalesce(CASE doc_id % 3 WHEN 0 THEN true WHEN 1 THEN false END, false)")
def translation_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    skipped = F.when(F.col("doc_id") % 3 == 0, True).when(F.col("doc_id") % 3 == 1, False)
    return H.audit_translations(read(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("source_language"), skipped.alias("skipped_translation"))).select("doc_id")


@query(f"""WITH {_ITEMS} SELECT item_id, CASE WHEN state <> 'pending' THEN replace(raw_text, 'text 1', 'Text-1') ELSE raw_text END AS raw_text, CASE WHEN state <> 'pending' THEN replace(cleaned_text, 'text 1', 'Text-1') ELSE cleaned_text END AS cleaned_text,
 CASE WHEN state <> 'pending' AND coalesce(contains(raw_text, 'text 1'), false) THEN 1 ELSE 0 END + CASE WHEN state <> 'pending' AND contains(cleaned_text, 'text 1') THEN 1 ELSE 0 END AS updated FROM items""")
def batch_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.batch_replace(_items(spark, sf_dir), ["raw_text", "cleaned_text"], "text 1", "Text-1").select("item_id", "raw_text", "cleaned_text", "updated")


@query(f"WITH {_ITEMS} SELECT item_id, CASE WHEN run_id % 8 = 1 THEN 'cancelled' ELSE state END AS state FROM items WHERE run_id % 8 <> 3 UNION ALL SELECT -l_linenumber, 'done' FROM (SELECT DISTINCT l_linenumber FROM items)")
def history_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items upserted, new ones added, and the items of some runs deleted."""
    i = _items(spark, sf_dir).select("item_id", "run_id", "state")
    new = i.select((F.col("item_id") % 10 * -1).alias("item_id"), F.lit(-1).cast("long").alias("run_id"), F.lit("done").alias("state")).distinct()
    changed = H.upsert(i, i.where("run_id % 8 = 1").withColumn("state", F.lit("cancelled")).union(new), "item_id")
    gone = i.where("run_id % 8 = 3").select("run_id").distinct()
    return H.delete_run(changed, changed.select("run_id").distinct(), gone)[0].select("item_id", "state")


@query("""WITH i AS (SELECT o_orderkey, 'C' || (o_orderkey % 900) AS stem, CASE WHEN o_orderkey % 3 <> 0 THEN 'k' || (o_orderkey % 11) ELSE '' END AS checksum, CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey % 5 END AS photo_id FROM orders),
d AS (SELECT 'C' || c_custkey AS stem, CASE WHEN c_custkey % 2 = 0 THEN 'k' || (c_custkey % 11) END AS c, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 5 END AS p FROM customer)
SELECT o_orderkey, CASE WHEN d.stem IS NULL THEN false ELSE coalesce(nullif(checksum, '') = c, photo_id = p, true) END AS resume FROM i LEFT JOIN d USING (stem)""")
def resume_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("c_custkey")
    i = read(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("C"), k % 900).alias("stem"), F.when(k % 3 != 0, F.concat(F.lit("k"), k % 11)).otherwise("").alias("checksum"), F.when(k % 4 != 0, F.col("o_custkey") % 5).alias("photo_id"))
    d = read(spark, sf_dir, "customer").select(F.concat(F.lit("C"), c).alias("stem"), F.when(c % 2 == 0, F.concat(F.lit("k"), c % 11)).alias("checksum"), F.when(c % 3 == 0, c % 5).alias("photo_id"))
    return R.decide(i, d).select("o_orderkey", "resume")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def open_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = read(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("stem"))
    return R.open_work(read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("stem")), done).select("o_orderkey")


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'translated' WHEN doc_id % 2 = 0 THEN 'cleaned' WHEN length(coalesce(text, '')) > 0 THEN 'raw_ocr' END AS stage, CASE WHEN doc_id % 3 = 0 THEN 't' || doc_id WHEN doc_id % 2 = 0 THEN 'c' || doc_id ELSE nullif(text, '') END AS page_text FROM documents""")
def stage_fallback_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    texts = {"translated": F.when(k % 3 == 0, F.concat(F.lit("t"), k)).otherwise(""), "cleaned": F.when(k % 2 == 0, F.concat(F.lit("c"), k)), "raw_ocr": F.col("text")}
    name, text = R.best_stage("translated", texts)
    return read(spark, sf_dir, "documents").select("doc_id", name.alias("stage"), text.alias("page_text"))


@query("""WITH e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back FROM events)
SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS done, count(*) FILTER (event_type = 'error') AS failed, max(event_type) FILTER (back = 1) AS last_kind FROM e GROUP BY user_id""")
def event_state_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagelake.streaming.run_events import fold

    return fold(read(spark, sf_dir, "events"))


@query("SELECT o_custkey, o_orderkey, (SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY o_custkey, o_orderkey) AS item_id FROM orders")
def recorded_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders play the items a run (their customer) has finished; they are numbered on from the highest id."""
    o = read(spark, sf_dir, "orders")
    r = H.recorded(o.select(F.col("o_orderkey").alias("item_id")), o.select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("ord")))
    return r.select(F.col("run_id").alias("o_custkey"), F.col("ord").alias("o_orderkey"), "item_id")


@query("SELECT n_name, (SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY n_nationkey) AS run_id FROM nation")
def started_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.started(_runs(spark, sf_dir), read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ord"), "n_name")).select("n_name", "run_id")


@query(f"""WITH {_RUNS}, {_ITEMS}, e AS (SELECT run_id, count(*) FILTER (state = 'failed') AS failed, sum(l_quantity) AS elapsed FROM items GROUP BY 1)
SELECT run_id, coalesce(CAST(finished AS VARCHAR), '2026-01-01 00:00:00') AS finished, CASE WHEN finished IS NULL THEN coalesce(e.failed, 0) ELSE runs.failed END AS failed, CAST(CASE WHEN finished IS NULL THEN coalesce(e.elapsed, 0) ELSE runs.elapsed END AS DOUBLE) AS elapsed FROM runs LEFT JOIN e USING (run_id)""")
def ended_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All runs that are still open end now, with what their items say."""
    runs = _runs(spark, sf_dir)
    items = _items(spark, sf_dir).select("run_id", "state", F.col("l_quantity").cast("double").alias("elapsed"))
    out = H.run_finished(runs, items, runs.where("finished is null").select("run_id"), F.lit("2026-01-01").cast("timestamp"))
    return out.select("run_id", F.date_format("finished", "yyyy-MM-dd HH:mm:ss").alias("finished"), "failed", "elapsed")


@query(f"WITH {_RUNS}, {_ITEMS} SELECT DISTINCT item_id, doc_type FROM items JOIN runs USING (run_id) WHERE l_partkey % 9 = 0")
def flagged_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _items(spark, sf_dir).withColumn("fabricated_at", F.col("l_partkey"))
    return H.latest_labels(i, _runs(spark, sf_dir)).select("item_id", "doc_type").distinct()
