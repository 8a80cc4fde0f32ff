"""Run history: totals, throughput, search, edits, labels. Tables: runs and run_items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelake.functions.text import ascii_lower

STAGES = "map<string,struct<state:string,elapsed:double,chars:bigint,error:string>>"


def run_totals(runs: DataFrame) -> DataFrame:
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return runs.agg(F.count(F.lit(1)).alias("runs"), zero("total").alias("files"), zero("failed").alias("failed"), zero("elapsed").alias("elapsed"))


def by_model(items: DataFrame, runs: DataFrame) -> DataFrame:
    """Average confidence by model, the most used first; items are counted a run before the join, so only sums move."""
    per_run = items.where("confidence is not null").groupBy("run_id").agg(F.sum("confidence").alias("s"), F.count(F.lit(1)).alias("n"))
    j = per_run.join(runs.select("run_id", "translate_model"), "run_id").groupBy(F.col("translate_model").alias("model"))
    return j.agg((F.sum("s") / F.sum("n")).alias("avg_conf"), F.sum("n").alias("n")).orderBy(F.desc("n"), "model")


def stage_throughput(items: DataFrame) -> DataFrame:
    """chars, elapsed and n of finished stages by name; what isn't JSON counts for nothing."""
    s = items.select(F.explode(F.from_json("stage_json", STAGES)).alias("stage", "s")).where("s.state = 'done'")
    return s.groupBy("stage").agg(F.sum(F.coalesce("s.chars", F.lit(0))).alias("chars"), F.sum(F.coalesce("s.elapsed", F.lit(0.0))).alias("elapsed"), F.count(F.lit(1)).alias("n"))


def stage_record(stages: Column) -> Column:
    """The JSON that a history row keeps of a map of stages: state, elapsed to a thousandth, chars and error of each."""
    return F.to_json(F.transform_values(stages, lambda _, s: F.struct(s["state"].alias("state"), F.round(s["elapsed"], 3).alias("elapsed"), s["chars"].alias("chars"), s["error"].alias("error"))))


def recent_runs(runs: DataFrame, limit: int = 20) -> DataFrame:
    return runs.where("finished is not null").orderBy(F.desc("run_id")).limit(limit).select("run_id", "started", "total", "failed", "elapsed")


def confidences(items: DataFrame) -> DataFrame:
    """item_id, confidence of the items that have one, in order."""
    return items.where("confidence is not null").select("item_id", "confidence").orderBy("item_id")


def run_summary(items: DataFrame) -> DataFrame:
    """done, failed and reused items of each run; reused: a stage was skipped as its output existed."""
    reused = F.exists(F.map_values("skip"), lambda r: r == "already_exists")
    return items.groupBy("run_id").agg(F.count_if(F.col("state") == "done").alias("done"), F.count_if(F.col("state") == "failed").alias("failed"), F.count_if(F.coalesce(reused, F.lit(False))).alias("reused"))


def matches(columns: list[str], term: str) -> Column:
    """Whether any column holds the term, ASCII case aside; its % and _ are wildcards. A blank term finds nothing."""
    if not term.strip():
        return F.lit(False)
    pattern = "%" + term.translate({c: c + 32 for c in range(65, 91)}).replace("\\", "\\\\") + "%"
    found = [ascii_lower(F.col(c)).like(pattern) for c in columns]
    out = F.coalesce(found[0], F.lit(False))
    for f in found[1:]:
        out = out | F.coalesce(f, F.lit(False))
    return out


def search(items: DataFrame, term: str, limit: int = 200) -> DataFrame:
    """Items whose name or source holds the term, newest first."""
    return items.where(matches(["name", "source_file"], term)).orderBy(F.desc("item_id")).limit(limit)


def fulltext(items: DataFrame, term: str, limit: int = 200) -> DataFrame:
    return items.where(matches(["raw_text", "cleaned_text", "translated_text"], term)).orderBy("item_id").limit(limit)


def upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of changes replace those with their key; both sides have the same columns."""
    return table.join(changes.select(key), key, "left_anti").select(*table.columns).unionByName(changes.select(*table.columns))


def started(runs: DataFrame, new: DataFrame) -> DataFrame:
    """new runs (ord and any fields) with run_id, counted on from the table's highest; a start adds few rows, which one task numbers."""
    top = runs.agg(F.coalesce(F.max("run_id"), F.lit(0))).scalar()
    return new.withColumn("_nth", F.row_number().over(Window.orderBy("ord"))).withColumn("run_id", top + F.col("_nth")).drop("_nth")


def recorded(items: DataFrame, finished: DataFrame) -> DataFrame:
    """finished items (run_id, ord and any fields) with item_id, counted on from the table's highest: runs in turn, in each by ord.

    Only counts of runs meet in one task, the items are numbered within their runs.
    """
    top = items.agg(F.coalesce(F.max("item_id"), F.lit(0))).scalar()
    n = finished.groupBy("run_id").agg(F.count(F.lit(1)).alias("_n"))
    before = n.select("run_id", (F.sum("_n").over(Window.orderBy("run_id")) - F.col("_n")).alias("_before"))
    j = finished.join(before, "run_id").withColumn("_nth", F.row_number().over(Window.partitionBy("run_id").orderBy("ord")))
    return j.withColumn("item_id", top + F.col("_before") + F.col("_nth")).drop("_before", "_nth")


def run_finished(runs: DataFrame, items: DataFrame, run_ids: DataFrame, now: Column) -> DataFrame:
    """runs with finished, failed and elapsed (of their items) set where they have ended."""
    of = items.join(run_ids, "run_id", "left_semi").groupBy("run_id").agg(F.count_if(F.col("state") == "failed").alias("_failed"), F.sum(F.coalesce("elapsed", F.lit(0.0))).alias("_elapsed"))
    ended = run_ids.distinct().withColumn("_ended", F.lit(True)).join(of, "run_id", "left")
    j = runs.join(ended, "run_id", "left")
    new = {"finished": now, "failed": F.coalesce("_failed", F.lit(0)), "elapsed": F.coalesce("_elapsed", F.lit(0.0))}
    return j.select(*[F.when(F.col("_ended"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in runs.columns])


def latest_labels(items: DataFrame, runs: DataFrame, limit: int | None = None) -> DataFrame:
    """Flagged items with their runs' document type, the latest flagged first, as many as asked for."""
    out = items.where("fabricated_result = 1").join(runs.select("run_id", "doc_type"), "run_id").orderBy(F.desc("fabricated_at"), F.desc("item_id"))
    return out if limit is None else out.limit(limit)


def delete_run(items: DataFrame, runs: DataFrame, run_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    return items.join(run_ids, "run_id", "left_anti"), runs.join(run_ids, "run_id", "left_anti")


def node_or_null(node: Column, limit: int = 256 * 1024) -> Column:
    """A JSON node, or null if it has more bytes than the limit."""
    return F.when(F.octet_length(node) <= limit, node)


def labels(items: DataFrame, runs: DataFrame) -> DataFrame:
    """Flagged items with where their models came from; paths are cut to their last segment."""
    r = runs.select("run_id", F.col("started").alias("run_started"), "doc_type", F.col("ocr_model").alias("configured_ocr_model"))
    base = F.element_at(F.split(F.replace("source_file", F.lit("\\"), F.lit("/")), "/"), -1)
    return items.where("fabricated_result = 1").join(r, "run_id").select(F.lit(1).alias("schema_version"), "item_id", "run_id", base.alias("source_file"), "run_started", "doc_type", "configured_ocr_model")


def audit_translations(records: DataFrame) -> DataFrame:
    """Records called English that were translated all the same."""
    return records.where("source_language = 'en' and not coalesce(skipped_translation, false)")


def batch_replace(items: DataFrame, columns: list[str], find: str, to: str) -> DataFrame:
    """items with the literal replaced in finished items' texts, and `updated`, the number of texts that changed."""
    open_ = F.col("state").isin("pending", "running", "cancelled")
    hit = {c: ~open_ & F.coalesce(F.contains(F.col(c), F.lit(find)), F.lit(False)) if find else F.lit(False) for c in columns}
    updated = sum((F.when(h, 1).otherwise(0) for h in hit.values()), F.lit(0))
    return items.withColumns({"updated": updated} | {c: F.when(h, F.replace(F.col(c), F.lit(find), F.lit(to))).otherwise(F.col(c)) for c, h in hit.items()})


def add_missing(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Additive migration: columns that an older table lacks, as nulls of their type."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})
