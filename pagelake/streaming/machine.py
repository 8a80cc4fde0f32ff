"""Items and stages of runs as a stream with state: what each is doing, closed at the end of its run or after silence.

Events may come out of order. They wait in the state until the watermark has passed them and are then applied by time, so
the states are those of a batch over the same events, however these were dealt to micro-batches. A run may have any number
of items: a key of the stream is a run and one of `buckets` shares of its items, and what concerns a whole run is sent to
each share.
"""

from __future__ import annotations

import heapq
import time
from bisect import insort
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Stages in order, and the states of items and stages.
STAGES = ("ocr", "cleanup", "title", "translate")
PENDING, RUNNING, DONE, FAILED, SKIPPED, CANCELLED = "pending", "running", "done", "failed", "skipped", "cancelled"
ENDED = (DONE, FAILED, SKIPPED, CANCELLED)

#: seq orders events of one time; outcome is the state that a stage or an item ends in.
EVENTS = "run_id long, item_id long, kind string, stage string, outcome string, error string, elapsed double, chars long, seq long, ts timestamp"
STATES = "run_id long, item_id long, stage string, state string, attempts int, elapsed double, chars long, error string, skip_reason string, version long"
#: The stage of rows that are about the item itself.
ITEM = ""
BUCKETS, IDLE_HOURS = 16, 24
#: Events in one value of the state, and how many are sorted before they are cut into such values.
CHUNK, SORTED = 1_000, 100_000
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Item:
    """One item: its state, its stages, and which of them have changed since they were last told."""

    def __init__(self, own: tuple | None = None, stages: dict[str, tuple] | None = None):
        self.state, self.attempts, self.error, self.last, self.version = own or (PENDING, 0, "", 0, 0)
        self.stages = stages or {s: (PENDING, 0.0, 0, "", "") for s in STAGES}
        self.changed = set() if own else {ITEM, *STAGES}

    def row(self) -> tuple:
        return self.state, self.attempts, self.error, self.last, self.version

    def end(self, state: str) -> None:
        """What hasn't ended of the stages is skipped; it waits for another try if the item failed."""
        self.state = state
        self.changed.add(ITEM)
        for name, s in self.stages.items():
            if s[0] in (PENDING, RUNNING):
                self.stages[name] = (PENDING if state == FAILED else SKIPPED, *s[1:])
                self.changed.add(name)

    def apply(self, e: Row | tuple) -> None:
        """One event. An item starts from pending only, has stages while it runs, and ends once; a retry makes it new."""
        kind, stage, outcome, error, elapsed, chars, at = e
        self.last, self.version = at, self.version + 1
        if kind == "item_retried" and self.state in ENDED:
            self.__init__((PENDING, self.attempts, "", at, self.version))
            self.changed = {ITEM, *STAGES}
        elif kind == "item_started" and self.state == PENDING:
            self.state, self.attempts = RUNNING, self.attempts + 1
            self.changed.add(ITEM)
        elif kind == "stage_started" and self.state == RUNNING and stage in self.stages:
            self.stages[stage] = (RUNNING, *self.stages[stage][1:])
            self.changed.add(stage)
        elif kind == "stage_finished" and self.state == RUNNING and stage in self.stages:
            before = self.stages[stage]
            if outcome == FAILED:
                self.error = error or ""
                self.stages[stage] = (FAILED, before[1], before[2], self.error, "")
                self.changed |= {stage, ITEM}
            else:
                self.stages[stage] = (outcome or DONE, elapsed or 0.0, chars or 0, "", (error or "") if outcome == SKIPPED else "")
                self.changed.add(stage)
        elif kind == "item_finished" and self.state in (PENDING, RUNNING):
            self.end(outcome or DONE)

    def told(self, run_id: int, item_id: int) -> Iterator[Row]:
        for stage in sorted(self.changed):
            if stage == ITEM:
                s = (self.state, self.attempts, sum(x[1] for x in self.stages.values()), sum(x[2] for x in self.stages.values()), self.error, "")
            else:
                state, elapsed, chars, error, reason = self.stages[stage]
                s = (state, self.attempts, elapsed, chars, error, reason)
            yield Row(run_id=run_id, item_id=item_id, stage=stage, state=s[0], attempts=s[1], elapsed=s[2], chars=s[3], error=s[4], skip_reason=s[5], version=self.version)
        self.changed = set()


class Machine(StatefulProcessor):
    """State of a share of a run: events that wait, items with their stages, and when running items count as given up.

    Every call of the state is a message to the JVM, so events wait in chunks and an item is one value. Chunks are sorted, and
    are read when their time has come: one share may have more events than fit in memory.
    """

    def __init__(self, idle_ms: int):
        self.idle = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        event = "at:long,seq:long,item_id:long,kind:string,stage:string,outcome:string,error:string,elapsed:double,chars:long"
        self.waiting = handle.getMapState("waiting", "first long, stamp long", f"events array<struct<{event}>>")
        stage = "stage:string,state:string,elapsed:double,chars:long,error:string,skip_reason:string"
        self.items = handle.getMapState("items", "item_id long", f"state string, attempts int, error string, last long, version long, stages array<struct<{stage}>>")
        self.due = handle.getMapState("due", "at long, item_id long", "nothing boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first, some, stamp = None, [], time.time_ns()
        for r in rows:
            some.append((int(r["at"]), r["seq"], r["item_id"], r["kind"], r["stage"], r["outcome"], r["error"], r["elapsed"], r["chars"]))
            first = some[-1][0] if first is None else min(first, some[-1][0])
            if len(some) == SORTED:
                stamp, some = self.wait(some, stamp), []
        self.wait(some, stamp)
        if first is not None:
            self.handle.registerTimer(max(first, timerValues.getCurrentWatermarkInMs()) + 1)
        return iter(())

    def wait(self, events: list[tuple], stamp: int) -> int:
        """Events as sorted chunks, each with a stamp of its own that grows with the time it came; the next stamp."""
        events.sort(key=lambda e: e[:2])
        for at in range(0, len(events), CHUNK):
            self.waiting.updateValue((events[at][0], stamp), (events[at : at + CHUNK],))
            stamp += 1
        return stamp

    def ready(self, chunks: Iterable[tuple[int, int]], now: int) -> Iterator[tuple]:
        """Events before `now` in order, from chunks in order; what is later waits on. Of events with one time and number the last to come counts."""
        heap, last, chunks = [], None, list(chunks)[::-1]
        while heap or chunks:
            while chunks and (not heap or chunks[-1][0] <= heap[0][0]):
                first, stamp = chunks.pop()
                events = [tuple(e) for e in self.waiting.getValue((first, stamp))[0]]
                self.waiting.removeKey((first, stamp))
                for k, e in enumerate(events):
                    if e[0] >= now:
                        self.waiting.updateValue((e[0], stamp), (events[k:],))
                        self.later.append(e[0])
                        break
                    heapq.heappush(heap, (e[0], e[1], -stamp, -k, e))
            e = heapq.heappop(heap)[-1]
            if e[:2] != last:
                yield e
            last = e[:2]

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        self.open: dict[int, Item] = {}
        before = {tuple(k) for k in self.due.keys()}
        self.alarms = sorted(before)
        waiting = sorted(tuple(k) for k in self.waiting.keys())
        self.later = [k[0] for k in waiting if k[0] >= now]
        self.known, names = self.items.exists(), None
        for at, _, item_id, *event in self.ready([k for k in waiting if k[0] < now], now):
            self.give_up(at)
            if item_id is not None:
                self.advance(item_id, (*event, at))
            elif event[0] == "run_finished":
                names = names if names is not None else {k[0] for k in self.items.keys()} if self.known else set()
                for i in names | self.open.keys():
                    if self.item(i).state not in ENDED:
                        self.advance(i, ("item_finished", None, CANCELLED, None, None, None, at))
        self.give_up(now)
        for i, item in self.open.items():
            self.items.updateValue((i,), (*item.row(), [(s, *item.stages[s]) for s in STAGES]))
        after = set(self.alarms)
        for k in before - after:
            self.due.removeKey(k)
        for k in after - before:
            self.due.updateValue(k, (True,))
        later = self.later + [k[0] for k in self.alarms[:1]]
        if later:
            self.handle.registerTimer(max(min(later), now) + 1)
        return (row for i, item in self.open.items() for row in item.told(key[0], i))

    def item(self, i: int) -> Item:
        if i not in self.open:
            own = self.items.getValue((i,)) if self.known else None
            self.open[i] = Item(tuple(own[:5]), {s[0]: tuple(s[1:]) for s in own[5]}) if own else Item()
        return self.open[i]

    def advance(self, i: int, event: tuple) -> None:
        """An event of an item, and the time by which the next has to come while it runs."""
        item = self.item(i)
        if item.state == RUNNING:
            self.alarms.remove((item.last + self.idle, i))
        item.apply(event)
        if item.state == RUNNING:
            insort(self.alarms, (item.last + self.idle, i))

    def give_up(self, now: int) -> None:
        """Running items that were silent too long before `now` are cancelled, at the end of that time."""
        while self.alarms and self.alarms[0][0] < now:
            at, i = self.alarms[0]
            self.advance(i, ("item_finished", None, CANCELLED, None, None, None, at))

    def close(self) -> None:
        pass


def states(events: DataFrame, delay: str = "1 hour", idle_hours: float = IDLE_HOURS, buckets: int = BUCKETS) -> DataFrame:
    """A stream of state changes (STATES) from a stream of EVENTS: a row for each item or stage that has changed, with a version that grows.

    Kinds: item_queued, item_started, stage_started, stage_finished, item_finished, item_retried, and, without an item,
    run_finished, which cancels what hasn't ended; an item that is silent for idle_hours while it runs is cancelled too. An
    ended item's open stages are skipped, a failed one's are pending. Events later than `delay` are left out, those without a
    run, a time or an order too; an event without an item counts if it ends the run, and a `tick` moves the time on; unknown kinds and stages change nothing.
    The session has to keep state in STORE.
    """
    known = events.where("run_id is not null and ts is not null and seq is not null and (item_id is not null or kind in ('run_finished', 'tick'))").withWatermark("ts", delay)
    shares = F.when(F.col("item_id").isNull(), F.sequence(F.lit(0), F.lit(buckets - 1))).otherwise(F.array(F.pmod(F.xxhash64("item_id"), F.lit(buckets)).cast("int")))
    dealt = known.withColumn("bucket", F.explode(shares)).withColumn("at", F.unix_millis("ts"))
    return dealt.groupBy("run_id", "bucket").transformWithState(Machine(int(idle_hours * 3_600_000)), STATES, "Update", "EventTime")


def run_totals(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """run_id, total, succeeded, failed, elapsed, finished, version of each run from its events, as a batch or, in update mode, a stream.

    Each event counts once within the watermark, by its number. finished is null until the run's end event has come; version,
    the number of events, grows with every change.
    """
    once = events.where("run_id is not null and seq is not null").withWatermark("ts", delay)
    once = once.dropDuplicatesWithinWatermark(["run_id", "seq"]) if once.isStreaming else once.dropDuplicates(["run_id", "seq"])
    ended = F.col("kind") == "item_finished"
    return once.groupBy("run_id").agg(
        F.count_if(F.col("kind") == "item_queued").alias("total"), F.count_if(ended & (F.col("outcome") == DONE)).alias("succeeded"), F.count_if(ended & (F.col("outcome") == FAILED)).alias("failed"),
        F.coalesce(F.sum(F.when(F.col("kind") == "stage_finished", F.col("elapsed"))), F.lit(0.0)).alias("elapsed"), F.max(F.when(F.col("kind") == "run_finished", F.col("ts"))).alias("finished"), F.count(F.lit(1)).alias("version"),
    )
