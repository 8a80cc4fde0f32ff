"""Queries of pages of a run: line items play lines, steps and stages of an order's page, documents play texts and errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelake.operators import pages as P
from pagelake.plans.registry import query, read


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND text IS NOT NULL THEN 'p' || text ELSE coalesce(text, 'file') END AS text FROM documents""")
def page_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    files = d.select("doc_id", F.col("doc_id").cast("string").alias("stem"), F.coalesce("text", F.lit("file")).alias("text"))
    documents = d.select(F.col("doc_id").cast("string").alias("stem"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("p"), "text")).when(F.col("doc_id") % 3 == 1, "").alias("page_text"))
    return P.overlay(files, documents).select("doc_id", "text")


_LINES = """l AS (SELECT l_orderkey AS page, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS INTEGER) AS pos, CAST(l_orderkey % 4 AS INTEGER) AS cnt, CASE WHEN l_partkey % 4 < l_orderkey % 4 THEN l_partkey % 4 WHEN l_suppkey % 3 < l_orderkey % 4 THEN l_suppkey % 3 END AS owner, CAST(l_quantity AS INTEGER) AS q FROM lineitem)"""


@query(f"""WITH {_LINES}, n AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY pos) AS line, coalesce(owner, cnt) AS nth FROM l),
s AS (SELECT page, nth, min(pos) AS first, string_agg('kraken-line-' || lpad(CAST(line AS VARCHAR), 4, '0'), ',' ORDER BY pos) AS lines, bool_or(owner IS NULL) AS orphan, min(pos) || ' ' || min(q) || ' ' || (max(pos) + 5) || ' ' || (max(q) + 2) AS box FROM n GROUP BY page, nth),
g AS (SELECT page, k AS nth FROM (SELECT o_orderkey AS page, unnest(range(0, o_orderkey % 4)) AS k FROM orders) UNION SELECT page, nth FROM s),
j AS (SELECT g.page, g.nth, first, lines, CASE WHEN orphan THEN box END AS box, count(first) OVER (PARTITION BY g.page) AS seen FROM g LEFT JOIN s ON s.page = g.page AND s.nth = g.nth)
SELECT page, 'kraken-' || lpad(CAST(nth + 1 AS VARCHAR), 4, '0') AS region, row_number() OVER (PARTITION BY page ORDER BY coalesce(first, seen), nth) - 1 AS place, coalesce(lines, '') AS lines, box FROM j""")
def lines_in_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, o = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    pos, q = F.col("pos"), F.col("l_quantity").cast("int")
    l = l.withColumn("pos", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")) - 1)
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    ids = F.array(F.concat(F.lit("r"), F.col("l_partkey") % 4), F.concat(F.lit("r"), F.col("l_suppkey") % 3))
    lines = l.select(F.col("l_orderkey").alias("page"), pos.alias("pos"), ids.alias("region_ids"), F.array(at(pos, q), at(pos + 5, q + 2)).alias("boundary"), F.lit(None).cast(f"array<{P.POINT}>").alias("baseline"))
    k = F.explode(F.when(F.col("o_orderkey") % 4 > 0, F.sequence(F.lit(0), (F.col("o_orderkey") % 4 - 1).cast("int"))))
    regions = o.select(F.col("o_orderkey").alias("page"), k.alias("nth")).select("page", "nth", F.concat(F.lit("r"), "nth").alias("id"), F.lit("unclassified").alias("type"), F.array(at(F.lit(0), F.lit(0))).alias("boundary"))
    r = P.lines_to_regions(lines, regions)
    box = F.when(F.size("polygon") == 4, F.concat_ws(" ", F.col("polygon")[0]["x"], F.col("polygon")[0]["y"], F.col("polygon")[2]["x"], F.col("polygon")[2]["y"]))
    return r.select("page", "region", F.col("order").cast("long").alias("place"), F.array_join("lines", ",").alias("lines"), box.alias("box"))


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    value = F.when(n == 4, "no json").when(n == 5, '{"region_id": "r1", "error": ""}').otherwise(F.concat(F.lit('{"region_id": "r'), F.col("l_suppkey") % 3, F.lit('", "error": "e'), n, F.lit('"}')))
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), n.alias("pos"), F.when(n % 3 == 0, "ocr").otherwise("region-error").alias("name"), value.alias("value"))


@query("SELECT l_orderkey AS page, 'r' || (l_suppkey % 3) AS region_id, 'e' || max(l_linenumber) AS error FROM lineitem WHERE l_linenumber % 3 <> 0 AND l_linenumber NOT IN (4, 5) GROUP BY 1, 2")
def region_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.region_errors(_steps(spark, sf_dir))


@query("SELECT l_orderkey AS page, count(*) AS region_count, count(*) FILTER (l_linenumber % 3 <> 0) AS region_error_count FROM lineitem GROUP BY 1")
def region_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _steps(spark, sf_dir)
    return P.region_counts(s.select("page"), s)


@query("SELECT page, string_agg(mode, '+' ORDER BY first, mode) AS engine FROM (SELECT l_orderkey AS page, lower(l_returnflag || l_linestatus) AS mode, min(l_linenumber) AS first FROM lineitem GROUP BY ALL) GROUP BY page")
def engine_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = F.array_sort(F.collect_list(F.struct("l_linenumber", F.lower(F.concat("l_returnflag", "l_linestatus")).alias("mode"))))
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("page")).agg(told.alias("e")).select("page", P.engine_label(F.col("e.mode")).alias("engine"))


@query("SELECT stage, count(*) AS n FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN 'translated' WHEN doc_id % 2 = 0 THEN 'cleaned' WHEN length(coalesce(text, '')) > 0 THEN 'raw_ocr' END AS stage FROM documents) WHERE stage IS NOT NULL GROUP BY stage")
def stage_mix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagelake.plans.history import stage_fallback_pick

    return P.stage_mix(stage_fallback_pick(spark, sf_dir))


@query("SELECT l_orderkey AS file, sum(CASE WHEN l_linenumber % 4 = 0 THEN 0 ELSE l_quantity::DOUBLE END) AS elapsed, count(*) FILTER (l_linenumber % 4 <> 0) AS ran FROM lineitem GROUP BY 1")
def file_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    skipped = F.when(F.col("l_linenumber") % 4 == 0, True).when(F.col("l_linenumber") % 2 == 0, False)
    return P.timings(read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_quantity").cast("double").alias("elapsed"), skipped.alias("skipped")))


@query("SELECT o_custkey AS item_id, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS photos FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1")
def photo_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    chosen = o.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select(F.col("o_orderkey").alias("photo_id"))
    s = P.select_photos(o.select(F.col("o_custkey").alias("item_id"), F.col("o_orderkey").alias("photo_id")), chosen)
    return s.select("item_id", F.array_join(F.transform("photos", lambda x: x.cast("string")), ",").alias("photos"))


@query("SELECT p_partkey, lower(p_type[1:1]) || 'x' AS origin FROM part WHERE p_partkey % 3 <> 0")
def writable_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lower(F.left("p_type", F.lit(1))), F.lit("x")).alias("origin"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_partkey")).alias("photo_id"))
    return P.writable(p).select("p_partkey", "origin")


@query("SELECT p_partkey, array_to_string(list_transform(list_sort(list_distinct([p_size % 5, p_size % 3, p_size % 2])), lambda x: CAST(x AS VARCHAR)), ',') AS models FROM part")
def model_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size")
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(P.union_of(F.array(s % 5, s % 3), F.array(s % 2))).cast("array<string>"), ",").alias("models"))


_ERROR = """CASE doc_id % 5 WHEN 0 THEN 'request (' || (doc_id + 5000) || ' tokens) exceeds the available context size (4096 tokens)' WHEN 1 THEN 'This model''s Maximum context length is ' || doc_id || chr(10) || ', however more was asked'
 WHEN 2 THEN 'Error code: 404 - ' || source WHEN 3 THEN 'timeout 14041' END"""


@query(rf"""WITH e AS (SELECT doc_id, {_ERROR} AS error FROM documents), k AS (SELECT *, lower(error) LIKE '%exceeds the available context size%' OR regexp_matches(error, '(?is)maximum context length.{{0,80}}?(however|you requested|resulted in|but you)') AS long FROM e)
SELECT doc_id, CASE WHEN error IS NULL THEN NULL WHEN long THEN 'context' WHEN regexp_matches(error, '(^|\D)404(\D|$)') THEN 'missing' ELSE 'other' END AS kind,
 CASE WHEN long THEN CAST(nullif(regexp_extract(error, '\((\d+) tokens', 1), '') AS INTEGER) END AS needed, CASE WHEN long THEN CAST(nullif(regexp_extract(error, 'size \((\d+) tokens', 1), '') AS INTEGER) END AS window FROM k""")
def model_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    error = (
        F.when(k % 5 == 0, F.concat(F.lit("request ("), k + 5000, F.lit(" tokens) exceeds the available context size (4096 tokens)"))).when(k % 5 == 1, F.concat(F.lit("This model's Maximum context length is "), k, F.lit("\n, however more was asked")))
        .when(k % 5 == 2, F.concat(F.lit("Error code: 404 - "), "source")).when(k % 5 == 3, "timeout 14041")
    )
    return read(spark, sf_dir, "documents").select("doc_id", P.model_error(error).alias("e")).select("doc_id", "e.kind", "e.needed", "e.window")


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(lower(trim(coalesce(lang, 'en'))), '^\p{L}{1,3}$') THEN lower(trim(coalesce(lang, 'en'))) ELSE 'en' END AS language,
 regexp_replace(replace(replace(replace(replace(coalesce(text, ''), chr(10), ' '), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '  +', ' ', 'g') AS cell FROM documents""")
def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", P.note_language(F.col("lang")).alias("language"), P.escape_markup(P.cell_text(F.coalesce("text", F.lit("")))).alias("cell"))


@query("""WITH e AS (SELECT user_id, arg_max(event_type, event_id) AS kind FROM events GROUP BY user_id)
SELECT count(*) AS items, count(*) FILTER (kind = 'purchase') AS done, count(*) FILTER (kind = 'error') AS failed, count(*) FILTER (kind NOT IN ('purchase', 'error')) AS skipped FROM e""")
def finished_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's totals as it ends: what isn't finished by then is skipped."""
    from pagelake.streaming.run_events import fold, state_of

    s = fold(read(spark, sf_dir, "events")).select(P.closed_states(state_of(F.col("last_kind")), F.lit(False)).alias("state"))
    return s.agg(F.count(F.lit(1)).alias("items"), *[F.count_if(F.col("state") == k).alias(k) for k in ("done", "failed", "skipped")])


@query("SELECT l_orderkey AS run_id, l_linenumber AS item_id, l_partkey FROM lineitem WHERE l_orderkey = 7")
def run_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.items_of(read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("item_id"), "l_partkey"), 7)
