"""Runs as streams with state, and the keyed tables they are written to."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.plans import streams as Q
from pagelake.sinks.keyed import KeyedTable
from pagelake.streaming import machine as M

DAY = datetime(2024, 1, 1)


def plain(events, idle_hours):
    """States by a loop over one item's events after the other, in order of time."""
    order = sorted(events, key=lambda e: (e[9], e[8]))
    end = order[-1][9]
    items = {}
    for e in order:
        run, item, kind, stage, outcome, error, elapsed, chars, _, ts = e
        at = int((ts - datetime(1970, 1, 1)).total_seconds() * 1000)
        for own in items.values():
            if own.state == M.RUNNING and own.last + idle_hours * 3_600_000 < at:
                own.apply(("item_finished", None, M.CANCELLED, None, None, None, own.last + int(idle_hours * 3_600_000)))
        if item is not None:
            items.setdefault((run, item), M.Item()).apply((kind, stage, outcome, error, elapsed, chars, at))
        elif kind == "run_finished":
            for (r, _), own in items.items():
                if r == run and own.state not in M.ENDED:
                    own.apply(("item_finished", None, M.CANCELLED, None, None, None, at))
    assert end is not None
    return {(run, item, stage): (own.state if stage == M.ITEM else own.stages[stage][0]) for (run, item), own in items.items() for stage in (M.ITEM, *M.STAGES)}


def made(n, seed):
    rng = random.Random(seed)
    kinds = ["item_queued", "item_started", "item_started", "stage_started", "stage_started", "stage_finished", "stage_finished", "item_finished", "item_retried", "unknown", "run_finished"]
    out = []
    for k in range(n):
        kind = rng.choice(kinds if k % 7 == 0 else kinds[:-1])
        item = None if kind == "run_finished" else rng.randint(1, 6)
        stage = rng.choice([*M.STAGES, "no stage", None])
        out.append((rng.randint(1, 3), item, kind, stage, rng.choice([M.DONE, M.FAILED, M.SKIPPED]), rng.choice(["why", None]), rng.choice([1.5, None]), 3, k, DAY + timedelta(minutes=k * 40 + rng.randint(0, 30))))
    return out


def test_stream_equals_a_loop_however_it_is_dealt(spark, tmp_path):
    events = made(120, 3)
    tick = (-1, None, "tick", None, None, None, None, None, 0, DAY + timedelta(days=300))
    noise = [(None, 1, "item_started", None, None, None, None, None, 1, DAY), (1, None, "item_started", None, None, None, None, None, 1, DAY), (1, 1, "item_started", None, None, None, None, None, None, DAY)]
    folder, base = str(tmp_path / "in"), str(tmp_path)
    table = KeyedTable(spark, f"{base}/out", T._parse_datatype_string(M.STATES), ("run_id", "item_id", "stage"), 4)
    rows = events + noise
    random.Random(1).shuffle(rows)
    parts = [sorted(events, key=lambda e: e[9])[:60], sorted(events, key=lambda e: e[9])[60:]]
    for k, part in enumerate(parts):
        random.Random(k).shuffle(part)  # within a batch in no order
        spark.createDataFrame(part + (noise if k == 0 else []), M.EVENTS).repartition(1).write.mode("append").parquet(folder)
        Q.follow(spark, folder, table, lambda s: M.states(s, "2 hours", idle_hours=10, buckets=2), base)  # each start goes on from the checkpoint
    spark.createDataFrame([tick], M.EVENTS).write.mode("append").parquet(folder)
    Q.follow(spark, folder, table, lambda s: M.states(s, "2 hours", idle_hours=10, buckets=2), base)
    expected = plain([*events, tick], 10)
    rows = table.read().collect()
    assert {(r["run_id"], r["item_id"], r["stage"]): r["state"] for r in rows} == expected and len(rows) == len(expected)
    assert {r["state"] for r in rows} <= {M.PENDING, M.DONE, M.FAILED, M.SKIPPED, M.CANCELLED}
    files = table.files()
    Q.follow(spark, folder, table, lambda s: M.states(s, "2 hours", idle_hours=10, buckets=2), base)  # nothing new
    assert table.files() == files


class Handle:
    """State in dictionaries that counts its calls, each of which is a message to the JVM."""

    def __init__(self):
        self.calls, self.timers, self.maps = 0, [], {}

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)

    def getMapState(self, name, *_):  # noqa: N802
        kept, handle = self.maps.setdefault(name, {}), self

        class Map:
            def __getattr__(self, call):
                handle.calls += 1
                return {"getValue": kept.get, "updateValue": kept.__setitem__, "removeKey": kept.pop, "containsKey": kept.__contains__, "keys": lambda: iter(list(kept)), "exists": lambda: bool(kept)}[call]

        return Map()


class Clock:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.at


@pytest.mark.parametrize("chunk, in_order", [(1_000, 100_000), (3, 10), (1, 1), (7, 25)])
def test_a_share_asks_the_state_for_chunks_and_items_not_for_events(monkeypatch, chunk, in_order):
    """Each event was written, read and removed by a message of its own."""
    monkeypatch.setattr(M, "CHUNK", chunk, raising=False)
    monkeypatch.setattr(M, "SORTED", in_order, raising=False)
    names = "run_id item_id kind stage outcome error elapsed chars seq ts".split()
    events, start = [e for e in made(300, 5) if e[0] == 1], datetime(1970, 1, 1)
    events = [(*e[:7], e[7], e[8], e[9]) for e in events]
    rows = [dict(zip(names, e, strict=True)) | {"at": int((e[9] - start).total_seconds() * 1000)} for e in events]
    handle, told = Handle(), {}
    machine = M.Machine(10 * 3_600_000)
    machine.init(handle)
    end = max(r["at"] for r in rows) + 300 * 86_400_000
    cut = sorted(r["at"] for r in rows)[len(rows) // 2]
    again = [{**r, "kind": "unknown"} for r in rows[:20]]  # come first, so the later ones with their time and number count
    parts = [again + [r for r in rows if r["at"] <= cut], [r for r in rows if r["at"] > cut]]
    for part, now in zip(parts, (cut - 5 * 3_600_000, end), strict=True):
        random.Random(chunk).shuffle(part) if part is parts[1] else None
        assert list(machine.handleInputRows((1, 0), iter(part), Clock(0))) == []
        for row in machine.handleExpiredTimer((1, 0), Clock(now), None):
            told[row["run_id"], row["item_id"], row["stage"]] = row["state"]
    assert told == plain([*events, (-1, None, "tick", None, None, None, None, None, 0, start + timedelta(milliseconds=end))], 10)
    assert not handle.maps["waiting"]
    assert chunk < 1_000 or handle.calls < 80 < len(events)


def test_item_goes_through_its_states():
    item = M.Item()
    for kind, stage, outcome in [("stage_started", "ocr", None), ("item_started", None, None), ("item_started", None, None), ("stage_started", "ocr", None), ("stage_finished", "ocr", M.DONE), ("stage_started", "title", None)]:
        item.apply((kind, stage, outcome, None, 2.0, 7, 5))
    assert (item.state, item.attempts, item.stages["ocr"][:3], item.stages["title"][0]) == (M.RUNNING, 1, (M.DONE, 2.0, 7), M.RUNNING)
    item.apply(("stage_finished", "title", M.FAILED, "broken", None, None, 6))
    item.apply(("item_finished", None, M.FAILED, None, None, None, 7))
    assert (item.state, item.error, item.stages["title"][3], item.stages["translate"][0]) == (M.FAILED, "broken", "broken", M.PENDING)
    item.apply(("item_finished", None, M.DONE, None, None, None, 8))
    assert item.state == M.FAILED
    item.apply(("item_retried", None, None, None, None, None, 9))
    item.apply(("item_started", None, None, None, None, None, 9))
    item.apply(("item_finished", None, M.DONE, None, None, None, 9))
    assert (item.state, item.attempts, item.error, {s[0] for s in item.stages.values()}) == (M.DONE, 2, "", {M.SKIPPED})


def test_totals_come_with_the_end_event_and_once(spark, tmp_path):
    def event(run, item, kind, outcome, seq, elapsed=1.0):
        return (run, item, kind, "ocr", outcome, None, elapsed, 1, seq, DAY + timedelta(minutes=seq))

    folder, base = str(tmp_path / "in"), str(tmp_path)
    schema = T._parse_datatype_string("run_id long, total long, succeeded long, failed long, elapsed double, finished timestamp, version long")
    table = KeyedTable(spark, f"{base}/out", schema, ("run_id",), 2)
    start = [event(1, 1, "item_queued", None, 0), event(1, 1, "stage_finished", M.DONE, 1), event(1, 1, "item_finished", M.DONE, 2), event(1, 2, "item_finished", M.FAILED, 3)]
    for rows in (start + start[:2], [event(1, None, "run_finished", None, 4), start[3]]):
        spark.createDataFrame(rows, M.EVENTS).coalesce(1).write.mode("append").parquet(folder)
        Q.follow(spark, folder, table, lambda s: M.run_totals(s), base)
        got = table.read().first()
        assert (got["total"], got["succeeded"], got["failed"], got["elapsed"]) == (1, 1, 1, 1.0) and (got["finished"] is None) == (rows is not start and len(rows) != 2)
    before = table.files()
    assert not table.upsert(table.read().withColumn("failed", F.lit(9).cast("long")), "version", batch=0) and table.files() == before


@pytest.fixture
def store(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "store"), T._parse_datatype_string("id long, text string, v int"), ("id",), 8)
    table.upsert(spark.createDataFrame([(k, f"t{k}", 1) for k in range(100)], "id long, text string, v int"))
    return table


def of(table):
    return {r["id"]: (r["text"], r["v"]) for r in table.read().collect()}


def test_only_touched_buckets_are_rewritten(spark, store):
    before = store.files()
    changes = spark.createDataFrame([(5, "new", 2), (None, "no key", 1)], "id long, text string, v int")
    store.upsert(changes)
    after = store.files()
    touched = {r[0] for r in changes.select(F.pmod(F.xxhash64("id"), F.lit(8))).collect()}
    assert {b for b in before if before[b] != after[b]} == touched and len(before) == 8
    assert of(store)[5] == ("new", 2) and of(store)[None] == ("no key", 1) and len(of(store)) == 101


def test_broken_write_changes_nothing(spark, store):
    before, rows = store.files(), of(store)

    @F.udf("string")
    def broken(k):
        if k == 77:
            raise ValueError("lost")
        return "x"

    with pytest.raises(Exception, match="lost"):
        store.upsert(store.read().withColumn("text", broken("id")), batch=5)
    assert store.files() == before and of(store) == rows and store.upsert(store.read().limit(0), batch=5)


def test_versions_and_batches(spark, store):
    new = spark.createDataFrame([(1, "old", 0), (2, "b", 3), (2, "c", 4)], "id long, text string, v int")
    assert store.upsert(new, "v", batch=1) and not store.upsert(new.withColumn("v", F.lit(9)), "v", batch=1)
    assert of(store)[1] == ("t1", 1) and of(store)[2] == ("c", 4)


def test_buckets_can_become_empty(spark, store):
    store.delete(store.read().select("id"))
    assert of(store) == {} and store.upsert(spark.createDataFrame([(1, "again", 1)], "id long, text string, v int")) and of(store) == {1: ("again", 1)}
    store.delete(spark.createDataFrame([(None,)], "id long"))
    none = KeyedTable(spark, store.path + "-none", store.schema, ("id",), 4)
    none.delete(spark.createDataFrame([(1,)], "id long"))
    assert none.read().count() == 0


def test_changes_of_a_keyed_table_are_worked_out_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)
    made = lambda: spark.createDataFrame(spark.sparkContext.parallelize(range(10), 2).map(lambda k: (seen.add(1), (k % 7, k))[1]), "k long, version int")
    table = KeyedTable(spark, str(tmp_path / "t"), made().schema, ("k",), 4)
    table.upsert(made(), "version", batch=0)
    assert seen.value == 10 and sorted(map(tuple, table.read().collect())) == [(0, 7), (1, 8), (2, 9), (3, 3), (4, 4), (5, 5), (6, 6)]
    table.delete(made().where("k < 6"))
    assert seen.value == 20 and [tuple(r) for r in table.read().collect()] == [(6, 6)]
    assert all(len(f) == 1 for f in table.files().values())
