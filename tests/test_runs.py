import pytest
from pyspark.sql import functions as F

from pagelake.effects import phases
from pagelake.effects import structured as J
from pagelake.operators import export as X
from pagelake.operators import history as H
from pagelake.operators.control import controlled
from pagelake.sources import projects as P


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def test_ways_to_json():
    assert J.rungs(["prompted", "native_schema"]) == ["native_schema", "prompted"]
    with pytest.raises(J.UnsupportedMode):
        J.rungs([])
    with pytest.raises(J.UnsupportedMode):
        J.rungs(["prompted"], "json_object")
    assert J.parsed("```json\n[1]\n```") == [1] and J.parsed("no") is None and J.parsed(None) is None
    asked = []

    def provider(mode, texts):
        asked.append((mode, list(texts)))
        return ["1" if t == mode else "x" for t in texts]

    J.stepwise(provider, J.MODES, lambda v: v == 1)(["json_object", "native_schema", "none"])
    assert asked == [("native_schema", ["json_object", "native_schema", "none"]), ("json_object", ["json_object", "none"]), ("prompted", ["none"])]


def test_a_failed_call_loses_its_row_only(spark):
    def provider(mode, texts):
        if "bad" in texts:
            raise ValueError("no")
        return ['{"a": "ü"}' for _ in texts]

    d = spark.createDataFrame([(1, "bad"), (2, "good"), (3, None)], "doc_id long, text string")
    got = J.structured(d, provider, J.MODES, lambda v: "a" in v)
    assert rows(got, "doc_id", "data", "mode_used", "repaired", "error") == [(1, None, None, False, "ValueError: no"), (2, '{"a":"ü"}', "native_schema", False, None), (3, '{"a":"ü"}', "native_schema", False, None)]
    assert J.structured(d.limit(0), provider, J.MODES, bool).count() == 0


def test_regions_of_a_page_fail_alone(spark):
    d = spark.createDataFrame([(1, "b", 1, "B", None), (1, "a", 0, "A", None), (1, "c", 2, None, "no outline"), (2, "z", 0, None, "no outline")], "page long, region string, place int, crop string, error string")
    got = {r["page"]: r for r in J.read_regions(d, lambda ts: ts).collect()}
    assert got[1]["text"] == "A\n\nB" and got[1]["region_count"] == 3 and got[1]["errors"][0]["region"] == "c"
    assert got[2]["text"] == "" and got[2]["region_error_count"] == 1 and J.read_regions(d.limit(0), lambda ts: ts).count() == 0


def test_controls(spark):
    items = spark.createDataFrame([(1, 1, "pending"), (1, 2, "running"), (1, 3, "done"), (2, 1, "failed"), (2, 2, "pending"), (3, 1, None)], "run_id long, item_id int, state string")
    controls = spark.createDataFrame([(1, None, "pause", 1), (1, 2, "skip", 2), (2, 1, "retry", 1), (2, None, "cancel", 3), (2, None, "resume", 2), (9, 9, "skip", 1)], "run_id long, item_id int, action string, seq int")
    assert rows(controlled(items, controls), "run_id", "item_id", "state") == [(1, 1, "paused"), (1, 2, "skipped"), (1, 3, "done"), (2, 1, "cancelled"), (2, 2, "cancelled"), (3, 1, None)]
    assert rows(controlled(items, controls.limit(0)), "state") == rows(items, "state")


def test_history_counts_on(spark):
    none = spark.createDataFrame([], "item_id long")
    done = spark.createDataFrame([(2, 1), (1, 9), (1, 3)], "run_id long, ord int")
    assert rows(H.recorded(none, done), "run_id", "ord", "item_id") == [(1, 3, 1), (1, 9, 2), (2, 1, 3)]
    runs = spark.createDataFrame([(1, None, 0, 0.0), (2, "t", 7, 1.0)], "run_id long, finished string, failed long, elapsed double")
    assert rows(H.started(runs, spark.createDataFrame([(5, "b"), (4, "a")], "ord int, stages string")), "run_id", "stages") == [(3, "a"), (4, "b")]
    items = spark.createDataFrame([(1, "failed", 2.5), (2, "failed", 9.0)], "run_id long, state string, elapsed double")
    assert rows(H.run_finished(runs, items, runs.where("run_id = 1").select("run_id"), F.lit("now")), "run_id", "finished", "failed", "elapsed") == [(1, "now", 1, 2.5), (2, "t", 7, 1.0)]
    assert rows(H.run_finished(runs, items.limit(0), runs.select("run_id"), F.lit("now")), "failed", "elapsed") == [(0, 0.0)] * 2
    flagged = spark.createDataFrame([(1, 1, 1, "a"), (2, 1, 1, "c"), (3, 1, 0, "d"), (4, 1, 1, "c"), (5, 1, 1, None)], "item_id long, run_id long, fabricated_result int, fabricated_at string")
    assert [r["item_id"] for r in H.latest_labels(flagged, runs.withColumn("doc_type", F.lit("x")), 3).collect()] == [4, 2, 1]


def test_a_broken_phase_leaves_no_rows(spark, tmp_path):
    items, calls = spark.createDataFrame([("a", "1"), ("b", "x")], "stem string, text string"), F.col("text")
    with pytest.raises(Exception, match="x"):
        phases.run(items, [("p", lambda d: d.select("stem", F.when(calls == "x", F.raise_error(F.lit("x"))).otherwise(calls).alias("text")))], str(tmp_path / "run"))
    got = phases.run(items, [("p", lambda d: d)], str(tmp_path / "run"))
    assert rows(got, "stem", "text") == [("a", "1"), ("b", "x")]
    assert rows(phases.run(items.where("stem = 'a'"), [("p", lambda d: d.where("stem = 'b'"))], str(tmp_path / "run")), "stem") == [("a",)]


def test_exports(spark):
    stems = spark.createDataFrame([("s", 1, "a", "T"), ("s", 2, "b", ""), ("s", 3, "c", None), ("t", 1, "a", "U")], "batch string, ord int, stem string, item_title string")
    texts = spark.createDataFrame([("a", "raw_ocr", "raw"), ("a", "cleaned", "  "), ("b", "cleaned", "clean"), ("c", "other", "no"), ("d", "raw_ocr", "x")], "stem string, stage string, text string")
    books, lost = X.export_batches(stems, texts)
    assert rows(books, "batch", "title", "markdown")[0] == ("s", "T", "# T\n\n## T\n\n### Page 1\n\n[a]\n\nraw\n\n### Page 2\n\n[b]\n\nclean\n") and rows(lost, "batch", "n_skipped") == [("s", 1)]
    assert X.export_batches(stems, texts.limit(0))[0].count() == 0
    names = spark.createDataFrame([('a/b:"c',), (" ",), (None,)], "s string").select(X.file_name(F.col("s"), ".xml").alias("n"))
    assert [r["n"] for r in names.collect()] == ["a_b__c.xml", "batch.xml", "batch.xml"]
    states = spark.createDataFrame([("[]",), ('{"recent": "x"}',), (None,), ('{"recent": [{"a": 1}, "/p"]}',)], "text string")
    assert rows(X.recent_projects(states, spark.createDataFrame([("/p",), ("/q",)], "path string")), "place", "path") == [(1, "/p")]


def test_handovers(spark):
    now, t = F.lit("2026-01-01 12:00:00+00:00").cast("timestamp"), "a" * 32
    m = lambda **k: F.lit(str({"version": 1, "source": "r", "target": "w", "created": "2026-01-01T11:59:00+00:00", "body_file": "f.txt"} | k).replace("'", '"').replace("None", "null"))
    cases = [m(), m(version=2), m(created="soon"), m(created=None), m(source="q"), m(created="2026-01-01T10:59:59+00:00"), F.lit("[]"), F.lit(None).cast("string")]
    d = spark.range(1).select(F.posexplode(F.array(*cases)).alias("k", "value")).withColumn("token", F.lit(t))
    got = [r["status"] for r in P.judged_handovers(d.orderBy("k"), now, ["r", "w"]).collect()]
    assert got == ["ok", "broken", "broken", "broken", "unknown", "expired", "broken", "broken"]
    bodies = spark.createDataFrame([("f.txt", "text")], "body_file string, body string")
    assert rows(P.received(d, bodies, "w", now, ["r", "w"]), "body") == [("text",)] and P.received(d, bodies, "r", now, ["r", "w"]).count() == 0
    assert P.received(d, bodies.limit(0), "w", now, ["r", "w"]).count() == 0 and P.to_clean_up(d, now, ["r"]).count() == 6
