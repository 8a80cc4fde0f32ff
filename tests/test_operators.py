import datetime as dt
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelake.effects import stages as S
from pagelake.functions import geometry as G
from pagelake.functions import image as I
from pagelake.operators import catalog as C
from pagelake.operators import collect as X
from pagelake.operators import history as H
from pagelake.operators import ordering as O
from pagelake.operators import resume as R
from pagelake.sinks import tables as B
from pagelake.sinks.pagexml import render, to_page_xml
from pagelake.sources import files as A
from pagelake.sources import jsonld as J
from pagelake.sources import pagexml as P
from pagelake.sources import sqlite as Q


def test_ids_are_assigned_in_order(spark):
    cases = [["a", "a", " ", None, "a-1"], ["region-0002", "", ""], []]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, ids array<string>")
    got = {r["i"]: r["x"] for r in df.select("i", O.assign_ids(F.col("ids")).alias("x")).collect()}
    for i, wish in enumerate(cases):
        seen = []
        for k, w in enumerate(wish, 1):
            base = name = (w or "").strip() or f"region-{k:04d}"
            n = 1
            while name in seen:
                name, n = f"{base}-{n}", n + 1
            seen.append(name)
        assert got[i] == seen


def test_move_and_permutation(spark):
    r = spark.sql("SELECT array(1,2,3,4) a, array(4,3,2,1) b, array(1,1,2,3) c").select(
        O.move(F.col("a"), F.lit(4), F.lit(1)).alias("before"), O.move(F.col("a"), F.lit(1), F.lit(3), True).alias("after"), O.move(F.col("a"), F.lit(9), F.lit(3)).alias("none"), O.same_members(F.col("a"), F.col("b")).alias("yes"), O.same_members(F.col("a"), F.col("c")).alias("no")
    ).first()
    assert (r["before"], r["after"], r["none"], r["yes"], r["no"]) == ([4, 1, 2, 3], [2, 3, 1, 4], [1, 2, 3, 4], True, False)


def test_stems(spark):
    df = spark.createDataFrame([(1, "a", "c" * 40, 7), (2, "a", "", 8), (3, "a", None, None), (4, "b", None, None)], "o int, stem string, c string, p long")
    out = O.disambiguate(df, "stem", O.discriminator(F.col("c"), F.col("p"), F.lit("")), "o")
    assert {r["o"]: r["stem"] for r in out.collect()} == {1: "a", 2: "a__id8", 3: "a__dup", 4: "b"}


def catalog_file(path):
    c = sqlite3.connect(path)
    c.executescript("""CREATE TABLE lists(list_id INTEGER PRIMARY KEY, name TEXT, parent_list_id INTEGER); CREATE TABLE items(id INTEGER PRIMARY KEY, score REAL, note BLOB);
      INSERT INTO lists VALUES (0, 'root', NULL), (1, 'a', 2), (2, 'b', 1), (3, NULL, 1); INSERT INTO items VALUES (1, 0.5, x'00ff'), (2, NULL, NULL), (7, 2, NULL);""")
    c.commit()
    c.close()


def test_sqlite_source(spark, tmp_path):
    catalog_file(tmp_path / "project.tpy")
    (tmp_path / "project.2020.backup.tpy").write_bytes(b"")
    assert Q.database_in(str(tmp_path)) == str(tmp_path / "project.tpy")
    items = Q.table(spark, str(tmp_path), "items", 3)
    assert items.schema.simpleString() == "struct<id:bigint,score:double,note:binary>"
    assert sorted((r["id"], r["score"]) for r in items.collect()) == [(1, 0.5), (2, None), (7, 2.0)]
    assert [r["id"] for r in items.where("id > 1 and score is null").collect()] == [2]
    lists = Q.table(spark, str(tmp_path), "lists")
    assert [r["list_id"] for r in C.lists_of(lists).collect()] == [1, 2, 3]
    below = C.descendants(lists, lists.where("list_id = 1"))
    assert sorted(r["list_id"] for r in below.collect()) == [1, 2, 3]  # a cycle ends
    with pytest.raises(Exception, match="no table"):
        Q.table(spark, str(tmp_path), "nothing")


def test_trash_row_without_date_keeps_the_item(spark):
    items = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    trash = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "id int, deleted string")
    assert sorted(r["id"] for r in C.not_trashed(items, trash).collect()) == [2, 2, 3]


def test_history_labels_and_node_limit(spark):
    r = spark.createDataFrame([("x" * 10,), ("ä" * 200_000,)], "n string").select(H.node_or_null(F.col("n")).alias("n")).collect()
    assert r[0]["n"] and r[1]["n"] is None
    old = spark.createDataFrame([(1,)], "item_id int")
    assert H.add_missing(old, {"page": "int", "item_id": "int"}).columns == ["item_id", "page"]


def test_resume(spark):
    df = spark.createDataFrame([(True, "a", 1, "a", 2), (True, "a", 1, "b", 1), (True, None, 1, "b", 2), (True, "", None, None, None), (False, "a", 1, "a", 1), (None, None, None, None, None)], "e boolean, c string, p int, kc string, kp int")
    got = [r[0] for r in df.select(R.may_resume(F.col("e"), F.col("c"), F.col("p"), F.col("kc"), F.col("kp"))).collect()]
    assert got == [True, False, False, True, False, False]


def test_geometry(spark):
    r = spark.sql("SELECT array(struct(0.5D AS x, 2.5D AS y), struct(-3D AS x, 1e6D AS y)) p, array(struct(10.9D AS x, 10D AS y), struct(110D AS x, 60D AS y)) q").select(
        G.restored(F.col("p"), F.lit(10), F.lit(10), F.lit(10), F.lit(10)).alias("r"), G.crop_bounds(F.col("q"), 0.02, F.lit(111), F.lit(100)).alias("c")
    ).first()
    assert [(p["x"], p["y"]) for p in r["r"]] == [(0, 2), (0, 10)]
    assert tuple(r["c"]) == (8, 9, 111, 61)
    with pytest.raises(Exception, match="positive"):
        spark.sql("SELECT array(struct(1D AS x, 1D AS y)) p").select(G.restored(F.col("p"), F.lit(0), F.lit(1), F.lit(1), F.lit(1))).collect()
    e = spark.sql("SELECT array(struct(0 AS index, 'raw' AS unicode)) e").select(G.with_stage_text(F.col("e"), "cleaned", F.lit("new")).alias("e")).select(G.stage_text(F.col("e"), "cleaned").alias("c"), G.stage_text(F.col("e"), "translated").alias("t"), F.size("e").alias("n")).first()
    assert (e["c"], e["t"], e["n"]) == ("new", None, 2)


def page():
    when = dt.datetime(2026, 1, 2, 3, 4, 5, tzinfo=dt.UTC)
    pt = lambda *v: [{"x": a, "y": b} for a, b in v]
    line = {"id": "l1", "polygon": pt((1, 2), (3, 4)), "baseline": pt((1, 3), (3, 3)), "equivs": [{"index": 0, "unicode": "über <all>"}]}
    regions = [
        {"id": "b", "type": "other", "custom": "", "polygon": pt((0, 0), (9, 9)), "confidence": None, "equivs": [{"index": 1, "unicode": "two"}, {"index": 0, "unicode": "one"}], "lines": []},
        {"id": "a", "type": "marginalia", "custom": "structure {type:marginalia;}", "polygon": pt((5, 5)), "confidence": 0.91, "equivs": [{"index": 0, "unicode": "note"}], "lines": [line]},
    ]
    return {"image_filename": "n.jpg", "image_width": 997, "image_height": 613, "creator": "test", "created": when, "last_change": when, "steps": [{"name": "ocr", "value": "{}", "date": None}], "regions": regions, "reading_order": ["a", "b"], "group_id": "reading-order", "pc_gts_id": None}


def test_page_xml_round_trip(spark):
    data = render(page())
    assert data.startswith(b"<?xml version='1.0' encoding='utf-8'?>\n<PcGts xmlns=") and data.endswith(b"</PcGts>\n")
    assert data.index(b'index="0" regionRef="a"') < data.index(b'index="1" regionRef="b"') and b'conf="0.91"' in data
    df = spark.createDataFrame([(1, data.decode()), (2, data.decode().replace("2019-07-15", "2013-07-15")), (3, "no xml"), (4, data.decode().replace("997", "wide")), (5, None), (6, data.decode().replace("5,5", "5;5"))], "i int, xml string")
    got = {r["i"]: r for r in P.parse(df).collect()}
    assert [got[i]["error"] for i in range(1, 7)] == [None, "another namespace", "not a page document", "image size", "not a page document", "coordinates"]
    p = got[1]["page"]
    assert p["reading_order"] == ["a", "b"] and [r["id"] for r in p["regions"]] == ["b", "a"] and p["regions"][1]["confidence"] == 0.91
    again = P.parse(df.where("i = 1")).select(to_page_xml("page").alias("x"), P.page_text(F.col("page"), 0).alias("t")).first()
    assert bytes(again["x"]) == data and again["t"] == "note\n\none"


def test_jsonld(spark):
    doc = '{"@graph":[{"@type":"Item","title":[{"@value":" Box 1 "}],"photo":[{"path":"a\\\\b.jpg","checksum":"c"},{"path":"//srv/x.jpg"},7,{"mimetype":"image/png"},{"path":"/etc/x.jpg"},{"path":"../x.jpg"},{"path":"p.pdf","mimetype":"application/pdf"},{"path":"q.pdf","page":3}]},{"@type":["x#Item"],"photo":{"path":"/data/z.png"}},{"@type":"Template"},5]}'
    deep = "[" * 40 + "]" * 40
    df = spark.createDataFrame([("f1", "/exports", doc), ("f2", None, '{"@type":"Item","dc:title":"T","photo":[{"path":"r.jpg"}]}'), ("f3", "/e", deep), ("f4", "/e", "{"), ("f5", "/e", "7")], "path string, folder string, text string")
    errors = {r["path"]: r["b"]["error"] for r in df.withColumn("b", J.json_budget("text")).collect()}
    assert errors == {"f1": None, "f2": None, "f3": "too deep", "f4": "no JSON", "f5": "scalar root"}
    items = J.items(df)
    assert sorted((r["path"], r["title"]) for r in items.collect()) == [("f1", "Box 1"), ("f1", "Item 2"), ("f2", "T")]
    got = {(r["path"], r["idx"], r["photo_index"]): r for r in J.photos(items).collect()}
    assert [got["f1", 0, k]["status"] for k in range(8)] == ["ok", "unc", "not_object", "no_path", "protected_root", "escapes", "ok", "ok"]
    assert got["f1", 0, 0]["resolved"] == "/exports/a/b.jpg" and got["f1", 0, 6]["page"] == 0 and got["f1", 0, 7]["page"] == 3 and got["f1", 0, 0]["page"] is None
    assert got["f1", 1, 0]["status"] == "ok" and got["f2", 0, 0]["status"] == "needs_folder"
    assert J.group_id('{"b": 1, "a": "ü"}', 3) == J.group_id('{"a":"ü","b":1}', 3)


def test_files_manifest_and_markdown(spark, tmp_path):
    for name, text in (("cleaned/text/Box/a_p0001.txt", "one"), ("cleaned/text/Box/a_p0002.txt", "two\nlines"), ("json/a.json", '{"stage": "raw_ocr", "page": 1}'), ("json/b.json", "{oops"), ("img/x.JPG", "-"), ("img/y.gif", "-")):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    t = A.stage_texts(spark, str(tmp_path / "cleaned/text"))
    assert sorted((r["stem"], r["text"]) for r in t.collect()) == [("Box/a_p0001", "one"), ("Box/a_p0002", "two\nlines")]
    good, bad = A.sidecars(spark, str(tmp_path / "json"))
    assert [r["stage"] for r in good.collect()] == ["raw_ocr"] and bad.count() == 1
    assert [r["stem"] for r in A.pages(spark, str(tmp_path / "img")).collect()] == ["x"]
    entries = spark.createDataFrame([("Box/a_p0001", '{"page_number":1}'), ('q"\\', '{"page_number":2}')], "stem string, entry string")
    whole = B.manifest_json(entries, "e.json", F.lit("2026-01-01T00:00:00+00:00"))
    back = A.manifest(whole.withColumnRenamed("manifest", "text"))
    assert sorted((r["key"], r["entry"]) for r in back.collect()) == [("Box/a_p0001", '{"page_number":1}'), ('q"\\', '{"page_number":2}')]
    assert sorted(r["key"] for r in A.manifest(entries.select(F.lit('{"k": {"a": 1}}').alias("text")).limit(1)).collect()) == ["k"]
    pages = spark.createDataFrame([("b", 1, "l1", "t1", "S"), ("b", 2, "l2", "t2", ""), ("b", 3, "l3", "t3", "S"), ("b", 4, "l4", "t4", "Z")], "book string, n int, label string, text string, section string")
    assert X.markdown(pages, "book", ["n"]).first()["markdown"] == "# b\n\n## S\n\n### Page 1\n\n[l1]\n\nt1\n\n### Page 2\n\n[l2]\n\nt2\n\n### Page 3\n\n[l3]\n\nt3\n\n## Z\n\n### Page 4\n\n[l4]\n\nt4\n"
    B.write_stage(t.select("stem", "text", F.lit("cleaned").alias("stage")), str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).where("stage = 'cleaned'").count() == 2
    B.write_files(t, str(tmp_path / "again"))
    assert (tmp_path / "again/Box/a_p0002.txt").read_text() == "two\nlines"
    files = spark.createDataFrame([(1, "a.jpg", 5), (2, "a.jpg", 60_000_000), (3, "b", 1)], "o int, name string, length long")
    up = A.uploads(files, spark.createDataFrame([("b",)], "name string"), "o")
    assert sorted((r["o"], r["saved_as"], r["status"]) for r in up.collect()) == [(1, "a.jpg", "ok"), (2, "a_1.jpg", "too_large"), (3, "b_1", "ok")]
    assert spark.range(1).select(B.provenance({"b": F.lit("x"), "a": F.lit(1), "c": F.lit("")})).first()[0] == '{"a":"1","b":"x"}'


def test_effects(spark):
    pages = spark.createDataFrame([(1, "Der Brief aus Elsass liegt hier.", "p1"), (2, "An English page.", "p2"), (3, "boom", "p3")], "doc_id long, text string, stem string")

    def model(texts):
        if any("boom" in t for t in texts):
            raise ValueError("no")
        return texts

    said = {r["doc_id"]: (r["answer"], r["error"]) for r in S.call(pages, model).collect()}
    assert said[1] == ("Der Brief aus Elsass liegt hier.", None) and said[3] == (None, "ValueError: no")
    c = {r["doc_id"]: (r["cleaned"], r["ok"]) for r in S.clean(pages, lambda ts: [t.replace("Elsass", "Elass") for t in ts]).collect()}
    assert c[1] == ("Der Brief aus Elsass liegt hier.", False) and c[2] == ("An English page.", True)
    s = {r["doc_id"]: r["ok"] for r in S.structure(pages, lambda ts: [t.replace(" aus", "\n\naus") if "Brief" in t else t + " more" for t in ts]).collect()}
    assert s == {1: True, 2: False, 3: False}
    t = {r["doc_id"]: (r["source_language"], r["skipped"], r["translated"]) for r in S.translate(pages, lambda ts: ["de" if "Brief" in t else "en, de" for t in ts], lambda ts: ["perhaps " + t for t in ts]).collect()}
    assert t[1][:2] == ("de", False) and t[1][2].startswith("perhaps") and t[2] == ("en", True, "An English page.")
    names = {r["doc_id"]: r["title"] for r in S.titles(pages, lambda ts: ['```json\n{"title": "A fine letter"}\n```' if "Brief" in t else "x x x" for t in ts]).collect()}
    assert names == {1: "A fine letter", 2: "p2", 3: "p3"}
    calls = []

    def flaky(texts):
        calls.append(1)
        if len(calls) < 3:
            raise ConnectionError
        return texts

    assert S.retried(flaky, sleep=lambda _: None)(["a"]) == ["a"] and len(S.ladder()) == 8 and len(S.ladder(step=0, most=9)) == 50
    images = spark.createDataFrame([(1, "good", False), (2, "loop", False), (3, "", True)], "doc_id long, image string, blank boolean")
    good, bad = S.read_pages(images, lambda ts: ["again\n" * 40 if t == "loop" else "fine" for t in ts])
    assert sorted((r["doc_id"], r["text"], r["engine"]) for r in good.collect()) == [(1, "fine", "vision"), (3, "", "blank")] and [r["reason"] for r in bad.collect()] == ["lines"]
    have = spark.createDataFrame([("qwen:7b",), ("m-1",)], "name string")
    want = spark.createDataFrame([("ocr", "x", 0), ("ocr", "qwen-7b", 1), ("chat", "none", 0)], "role string, name string, ord int")
    assert {r["role"]: (r["model"], r["how"]) for r in S.resolve_model(have, want).collect()} == {"ocr": ("qwen:7b", "recommended"), "chat": ("m-1", "fallback")}
    assert {r["how"] for r in S.resolve_model(have, want, "gone").collect()} == {"configured_missing"}


def test_streams_equal_batches(spark, sf_dir, tmp_path):
    from pagelake.streaming import run_events as E

    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "history")

    def read():
        import os

        return spark.read.parquet(out) if os.path.exists(out) else None

    save = E.record(None, read, lambda d: d.write.mode("append").parquet(out))
    q = E.events(spark, str(tmp_path / "in")).writeStream.foreachBatch(save).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    done = {r["user_id"] for r in e.where("event_type in ('purchase', 'error')").collect()}
    rows = spark.read.parquet(out).collect()
    assert {r["user_id"] for r in rows} == done and len(rows) == len(done)
    q = E.fold(E.events(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("fold").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("fold").collect())) == sorted(map(tuple, E.fold(e).collect()))


def test_pixels():
    assert I.is_blank(np.full((9, 9), 200)) and not I.is_blank(np.arange(81).reshape(9, 9) * 3)
    a = np.arange(6).reshape(2, 3)
    assert [I.oriented(a, k).shape for k in range(1, 9)] == [(2, 3)] * 4 + [(3, 2)] * 4
    assert (I.oriented(a, 2) == a[:, ::-1]).all() and (I.oriented(a, 4) == a[::-1]).all() and (I.oriented(a, 5) == a.T).all() and (I.oriented(a, 7) == a[::-1, ::-1].T).all()
    assert (I.oriented(a, 6) == np.rot90(a, -1)).all() and (I.oriented(a, 8) == np.rot90(a)).all()
    base = np.full((80, 120), 255, np.uint8)
    base[20:30, 20:90] = 0
    scan = base.copy()
    scan[33:36, 20:90] = 0  # a stroke below ink
    scan[60:75, 100:115] = 0
    strength = I.residual(base, scan)
    parts = [d for p in I.components(strength > 0) if (d := I.described(p, strength, base))]
    assert [p["bbox"] for p in parts] == [(20, 33, 70, 3), (100, 60, 15, 15)] and parts[0]["has_ink_above"] and parts[0]["deviation_deg"] < 1
    assert (I.aligned(base, I.moved(base, 4, -6)) == I.moved(base, 4, -6)).all() and (I.moved(base, 99, 0) == 255).all() and (I.moved(base, 0, -500) == 255).all()
    for other, why in ((base[1:], "sizes"), (np.random.default_rng(1).integers(0, 256, base.shape), "shift")):
        with pytest.raises(ValueError, match=why):
            I.marks_of(base, other)
    assert [m["bbox"] for m in I.marks_of(base, scan)] == [(20, 33, 70, 3), (100, 60, 15, 15)]
    bgr = np.stack([base, base // 2, base // 3], 2)
    assert (I.channel(bgr, "green") == base // 2).all() and I.channel(bgr)[0, 0] == round(0.114 * 255 + 0.587 * 127 + 0.299 * 85)
    dy, dx, sure = I.shift_of(np.roll(base, (3, -5), (0, 1)), base)
    assert (abs(dy), abs(dx)) == (3, 5) and sure > 0.5
    assert I.flattened(np.array([[10, 20], [30, 40]]), gamma=1.2).max() == 255
