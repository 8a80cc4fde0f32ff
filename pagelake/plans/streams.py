"""Queries of runs that are followed as streams: states of items and stages, totals, and the keyed tables that hold them."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.plans.registry import query, read
from pagelake.sinks.keyed import KeyedTable
from pagelake.store import shared_dir, stash
from pagelake.streaming import machine as M

#: Hours after which a running item counts as given up, in the queries.
IDLE = 48

_STAGE_LIST = "[" + ", ".join(f"'{s}'" for s in M.STAGES) + "]"
_EVENTS = f"""e AS (SELECT user_id AS run_id, CASE WHEN NOT (event_type = 'view' AND k < 5) THEN k % 5 END AS item_id,
 CASE WHEN event_type = 'view' AND k < 5 THEN 'run_finished' WHEN event_type = 'signup' AND k >= 80 THEN 'item_retried' WHEN event_type = 'signup' AND k >= 70 THEN 'item_queued' WHEN event_type = 'signup' THEN 'item_started' WHEN event_type = 'view' THEN 'stage_started' WHEN event_type = 'purchase' AND k < 50 THEN 'item_finished' ELSE 'stage_finished' END AS kind,
 {_STAGE_LIST}[1 + CAST(k // 5 % 4 AS INTEGER)] AS stage, CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'purchase' AND value < 10 THEN 'failed' WHEN event_type = 'click' AND k >= 90 THEN 'skipped' ELSE 'done' END AS outcome,
 CASE WHEN event_type = 'error' THEN 'no ' || k WHEN event_type = 'click' AND k >= 90 THEN 'already_exists' END AS error, value AS elapsed, k AS chars, event_id AS seq, ts, epoch_us(ts) // 1000 AS ms FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events))"""


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of events as events of runs: users are runs, each with five items."""
    k, kind, value = F.regexp_extract("props", "[0-9]+", 0).cast("long"), F.col("event_type"), F.col("value")
    ends = (kind == "view") & (k < 5)
    name = (
        F.when(ends, "run_finished").when((kind == "signup") & (k >= 80), "item_retried").when((kind == "signup") & (k >= 70), "item_queued").when(kind == "signup", "item_started")
        .when(kind == "view", "stage_started").when((kind == "purchase") & (k < 50), "item_finished").otherwise("stage_finished")
    )
    reused = (kind == "click") & (k >= 90)
    outcome = F.when((kind == "error") | ((kind == "purchase") & (value < 10)), M.FAILED).when(reused, M.SKIPPED).otherwise(M.DONE)
    stage = F.array(*map(F.lit, M.STAGES))[(F.floor(k / 5) % 4).cast("int")]
    error = F.when(kind == "error", F.concat(F.lit("no "), k)).when(reused, "already_exists")
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), F.when(~ends, k % 5).alias("item_id"), name.alias("kind"), stage.alias("stage"), outcome.alias("outcome"), error.alias("error"), value.alias("elapsed"), k.alias("chars"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts")
    )


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def follow(spark: SparkSession, folder: str, table: KeyedTable, stream, base: str) -> None:
    """Run a stream over what lies in the folder into a keyed table; a repeated start goes on where the last one stopped."""
    source = spark.readStream.schema(M.EVENTS).option("maxFilesPerTrigger", 8).parquet(folder)

    def save(batch: DataFrame, k: int) -> None:
        table.upsert(batch, version="version", batch=k)

    with _settings(spark, {"spark.sql.streaming.stateStore.providerClass": M.STORE}):
        q = stream(source).writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()


def _as_files(events: DataFrame, base: str, parts: int = 3) -> str:
    """The events as files written one after the other, each a span of time, with a tick long after the last."""
    folder, spark = f"{base}/in", events.sparkSession
    low, high = events.agg(F.min("ts"), F.max("ts")).first()
    if low is not None:
        step = (high - low) / parts
        for k in range(parts):
            span = events.where((F.col("ts") >= low + k * step) & ((F.col("ts") < low + (k + 1) * step) | (k == parts - 1)))
            span.repartition(2).write.mode("append").parquet(folder)
    tick = [(-1, None, "tick", None, None, None, None, None, k, (high or 0)) for k in range(2)] if high else []
    for k, row in enumerate(tick):
        spark.createDataFrame([row], M.EVENTS).withColumn("ts", F.expr(f"ts + interval {400 + k} days")).write.mode("append").parquet(folder)
    return folder


def _end(state: str, st: str) -> str:
    """Stages when an item ends in a state: what is open is skipped, or waits if it failed."""
    return f"list_transform({st}, lambda s: CASE WHEN s IN ('pending', 'running') THEN CASE WHEN {state} = 'failed' THEN 'pending' ELSE 'skipped' END ELSE s END)"


_NEW = "['pending', 'pending', 'pending', 'pending']"
_ENDED = "('done', 'failed', 'skipped', 'cancelled')"
_LIMIT = IDLE * 3_600_000


@query(f"""WITH RECURSIVE {_EVENTS},
f AS (SELECT run_id, item_id, min({{'a': ms, 's': seq}}) AS first FROM e WHERE item_id IS NOT NULL GROUP BY ALL),
o AS MATERIALIZED (SELECT f.run_id, f.item_id, kind, list_position({_STAGE_LIST}, stage) AS place, outcome, error, elapsed, ms, row_number() OVER (PARTITION BY f.run_id, f.item_id ORDER BY ms, seq) AS i FROM f JOIN e ON e.run_id = f.run_id AND (e.item_id = f.item_id OR (e.kind = 'run_finished' AND {{'a': e.ms, 's': e.seq}} > f.first))),
s AS (SELECT run_id, item_id, CAST(0 AS BIGINT) AS i, 'pending' AS state, CAST(0 AS BIGINT) AS attempts, '' AS error, CAST(0 AS BIGINT) AS last, {_NEW} AS st, [CAST(0 AS DOUBLE), 0, 0, 0] AS el FROM f
 UNION ALL SELECT run_id, item_id, i,
  CASE WHEN kind = 'run_finished' THEN CASE WHEN state IN {_ENDED} THEN state ELSE 'cancelled' END WHEN kind = 'item_retried' AND state IN {_ENDED} THEN 'pending' WHEN kind = 'item_started' AND state = 'pending' THEN 'running' WHEN kind = 'item_finished' AND state IN ('pending', 'running') THEN outcome ELSE state END,
  CASE WHEN kind = 'item_started' AND state = 'pending' THEN attempts + 1 ELSE attempts END,
  CASE WHEN kind = 'item_retried' AND state IN {_ENDED} THEN '' WHEN kind = 'stage_finished' AND state = 'running' AND outcome = 'failed' THEN coalesce(own_error, '') ELSE error END,
  CASE WHEN kind = 'run_finished' AND state IN {_ENDED} THEN last ELSE ms END,
  CASE WHEN kind = 'item_retried' AND state IN {_ENDED} THEN {_NEW} WHEN kind = 'run_finished' AND state NOT IN {_ENDED} THEN {_end("'cancelled'", "st")} WHEN kind = 'item_finished' AND state IN ('pending', 'running') THEN {_end("outcome", "st")}
   WHEN state = 'running' AND kind = 'stage_started' THEN list_transform(st, lambda x, n: CASE WHEN n = place THEN 'running' ELSE x END) WHEN state = 'running' AND kind = 'stage_finished' THEN list_transform(st, lambda x, n: CASE WHEN n = place THEN outcome ELSE x END) ELSE st END,
  CASE WHEN kind = 'item_retried' AND state IN {_ENDED} THEN [CAST(0 AS DOUBLE), 0, 0, 0] WHEN state = 'running' AND kind = 'stage_finished' AND outcome <> 'failed' THEN list_transform(el, lambda x, n: CASE WHEN n = place THEN elapsed ELSE x END) ELSE el END
 FROM (SELECT * EXCLUDE (state, last, st), CASE WHEN idle THEN 'cancelled' ELSE state END AS state, CASE WHEN idle THEN last + {_LIMIT} ELSE last END AS last, CASE WHEN idle THEN {_end("'cancelled'", "st")} ELSE st END AS st
  FROM (SELECT s.run_id, s.item_id, s.state, s.attempts, s.error, s.last, s.st, s.el, o.i, o.kind, o.place, o.outcome, o.error AS own_error, o.elapsed, o.ms, s.state = 'running' AND s.last + {_LIMIT} < o.ms AS idle FROM s JOIN o ON o.run_id = s.run_id AND o.item_id = s.item_id AND o.i = s.i + 1))),
z AS (SELECT run_id, item_id, arg_max(state, i) AS state, arg_max(attempts, i) AS attempts, arg_max(error, i) AS error, arg_max(st, i) AS st, arg_max(el, i) AS el FROM s GROUP BY ALL),
y AS (SELECT run_id, item_id, CASE WHEN state = 'running' THEN 'cancelled' ELSE state END AS state, attempts, error, CASE WHEN state = 'running' THEN {_end("'cancelled'", "st")} ELSE st END AS st, el FROM z)
SELECT run_id, item_id, '' AS stage, state, CAST(attempts AS INTEGER) AS attempts, round(list_sum(el), 6) AS elapsed, error FROM y
UNION ALL SELECT run_id, item_id, {_STAGE_LIST}[n], st[n], CAST(attempts AS INTEGER), round(el[n], 6), NULL FROM y, range(1, 5) r(n)""")
def run_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items and stages of all runs as a stream leaves them in a keyed table, after several batches and two starts."""
    base = f"{shared_dir(spark)}/pagelake-states-{uuid.uuid4().hex}"
    folder = _as_files(run_events(spark, sf_dir), base)
    table = KeyedTable(spark, f"{base}/states", T._parse_datatype_string(M.STATES), ("run_id", "item_id", "stage"), 8)
    for _ in range(2):
        follow(spark, folder, table, lambda s: M.states(s, idle_hours=IDLE, buckets=2), base)
    out = table.read()
    return out.select("run_id", "item_id", "stage", "state", "attempts", F.round("elapsed", 6).alias("elapsed"), F.when(F.col("stage") == M.ITEM, F.col("error")).alias("error"))


@query(f"""WITH {_EVENTS} SELECT run_id, count(*) FILTER (kind = 'item_queued') AS total, count(*) FILTER (kind = 'item_finished' AND outcome = 'done') AS succeeded, count(*) FILTER (kind = 'item_finished' AND outcome = 'failed') AS failed,
round(coalesce(sum(elapsed) FILTER (kind = 'stage_finished'), 0), 6) AS elapsed, epoch_us(max(ts) FILTER (kind = 'run_finished')) // 1000 AS finished_ms, count(*) AS version FROM e GROUP BY run_id HAVING count(*) FILTER (kind = 'run_finished') > 0""")
def streamed_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of ended runs, kept up to date by a stream whose batches are written by key and version, each once; every event comes twice."""
    base = f"{shared_dir(spark)}/pagelake-totals-{uuid.uuid4().hex}"
    events = run_events(spark, sf_dir)
    folder = _as_files(events.unionByName(events), base)
    schema = T._parse_datatype_string("run_id long, total long, succeeded long, failed long, elapsed double, finished timestamp, version long")
    table = KeyedTable(spark, f"{base}/totals", schema, ("run_id",), 8)
    follow(spark, folder, table, lambda s: M.run_totals(s.where("kind <> 'tick'"), "1 day"), base)
    return table.read().where("finished is not null").select("run_id", "total", "succeeded", "failed", F.round("elapsed", 6).alias("elapsed"), F.unix_millis("finished").alias("finished_ms"), "version")


@query("""WITH i AS (SELECT l_orderkey * 100 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS item_id, l_orderkey AS run_id, l_linestatus AS state, l_extendedprice AS price FROM lineitem)
SELECT item_id, run_id, CASE WHEN price > 50000 THEN 'corrected' ELSE state END AS state, CASE WHEN price > 50000 THEN 2 ELSE 1 END AS version FROM i WHERE run_id NOT IN (SELECT o_orderkey FROM orders WHERE o_totalprice < 100000)
UNION ALL SELECT -o_orderkey, o_orderkey, 'added', 1 FROM orders WHERE o_totalprice > 300000""")
def history_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyed history of all items: filled, corrected by key, an old version sent again, rows added, and the items of cheap orders deleted."""
    base = f"{shared_dir(spark)}/pagelake-history-{uuid.uuid4().hex}"
    orders = read(spark, sf_dir, "orders")
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    items = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 100 + nth).cast("long").alias("item_id"), F.col("l_orderkey").cast("long").alias("run_id"), F.col("l_linestatus").alias("state"), "l_extendedprice")
    items = stash(items, "items")  # numbered once, read by three changes
    table = KeyedTable(spark, base, T._parse_datatype_string("item_id long, run_id long, state string, version int"), ("item_id",), 16)
    first = items.select("item_id", "run_id", "state", F.lit(1).alias("version"))
    table.upsert(first, "version", batch=0)
    table.upsert(items.where("l_extendedprice > 50000").select("item_id", "run_id", F.lit("corrected").alias("state"), F.lit(2).alias("version")), "version", batch=1)
    table.upsert(first.where("item_id < 50000"), "version", batch=2)
    table.upsert(orders.where("o_totalprice > 300000").select((-F.col("o_orderkey")).cast("long").alias("item_id"), F.col("o_orderkey").cast("long").alias("run_id"), F.lit("added").alias("state"), F.lit(1).alias("version")), "version", batch=3)
    cheap = orders.where("o_totalprice < 100000").select(F.col("o_orderkey").cast("long").alias("run_id"))
    table.delete(table.read().where("item_id > 0").join(cheap, "run_id", "left_semi"))
    return table.read()
