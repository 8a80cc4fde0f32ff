"""Controls of a run: pause, resume, cancel, skip and retry as rows of a table, applied by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Item states that have ended, and those a retry opens again.
ENDED = ("done", "failed", "cancelled", "skipped")
RETRIED = ("failed", "cancelled")


def controlled(items: DataFrame, controls: DataFrame) -> DataFrame:
    """items (run_id, item_id, state) with their state after the controls (run_id, item_id, action, seq).

    A control without item_id is one of the whole run. The last of an item's skip and retry counts, as does the last of a
    run's pause, resume and cancel: cancel ends what hasn't ended, skip ends what hasn't ended, retry opens a failed or
    cancelled item, pause holds what is pending. A running item of a paused run finishes.
    """
    last = F.max_by("action", "seq")
    of_run = controls.where("item_id is null and action in ('pause', 'resume', 'cancel')").groupBy("run_id").agg(last.alias("_run"))
    of_item = controls.where("item_id is not null and action in ('skip', 'retry')").groupBy("run_id", "item_id").agg(last.alias("_item"))
    j = items.join(of_item, ["run_id", "item_id"], "left").join(of_run, "run_id", "left")
    opened = F.when((F.col("_item") == "retry") & F.col("state").isin(*RETRIED), "pending").when((F.col("_item") == "skip") & ~F.col("state").isin(*ENDED), "skipped").otherwise(F.col("state"))
    state = F.when((F.col("_run") == "cancel") & ~opened.isin(*ENDED), "cancelled").when((F.col("_run") == "pause") & (opened == "pending"), "paused").otherwise(opened)
    return j.select(*[F.col(c) if c != "state" else state.alias("state") for c in items.columns])
