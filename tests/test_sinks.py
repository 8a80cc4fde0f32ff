"""Notes that are written whole or not at all, folders of projects, uploads, bounded JSON, image headers and alignment."""

import json
import random
import struct
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelake.functions import align as G
from pagelake.functions import image as I
from pagelake.plans.images import made_file, turned
from pagelake.sinks import layout as L
from pagelake.sinks import notes as N
from pagelake.sources import files as A
from pagelake.sources import jsonld as J


# notes


ENTRIES = [(1, None, "A note.", "p", "de"), (1, None, "A  note.\n", "p", "de"), (2, 7, "Two", "p", None), (3, 9, "wrong item", "p", "de"), (4, None, " ", "p", "de"), (5, None, "no photo", "p", "de")]


@pytest.fixture
def notes(spark):
    entries = spark.createDataFrame(ENTRIES, "photo_id long, item_id long, text string, project string, language string").repartition(3)
    return entries, spark.createDataFrame([(1, 6), (2, 7), (3, 8), (4, 8)], "photo_id long, item long")


def texts(spark, path):
    return sorted((r["photo_id"], r["text"], r["html"], r["language"]) for r in N.committed(spark, path).collect())


def test_notes_need_the_count_that_was_seen(spark, notes, tmp_path):
    path = str(tmp_path / "store")
    for wrong in (0, 2, 4):
        with pytest.raises(N.CountChanged):
            N.commit_notes(*notes, path, "p", wrong, "b")
    assert texts(spark, path) == [] and not list(Path(tmp_path).rglob("*.parquet"))
    assert N.commit_notes(*notes, path, "p", 3, "b") == {"written": 2, "skipped": 1}
    said = texts(spark, path)
    assert [s[:2] for s in said] == [(1, "A  note."), (2, "Two")] and said[0][2] == "<p>A  note.</p>"  # of equal notes the least text
    assert N.commit_notes(*notes, path, "p", 3, "b")["written"] == 0 and texts(spark, path) == said
    with pytest.raises(N.CountChanged):  # what is there now is a duplicate
        N.commit_notes(*notes, path, "p", 3, "c")
    assert N.commit_notes(*notes, path, "p", 0, "d") == {"written": 0, "skipped": 0} and texts(spark, path) == said


def test_failing_task_leaves_no_notes(spark, tmp_path):
    spark.dataSource.register(N.NoteSource)
    path = str(tmp_path / "store")

    @F.udf("string")
    def broken(k):
        if k == 7:
            raise ValueError("lost")
        return "x"

    rows = spark.range(8, numPartitions=4).select(F.col("id").alias("photo_id"), broken("id").alias("html"), F.lit("t").alias("text"), F.lit("de").alias("language"))

    def save(df, n, batch="b"):
        df.write.format("notes").mode("append").option("path", path).option("batch", batch).option("expected", str(n)).save()

    with pytest.raises(Exception, match="lost"):
        save(rows, 8)
    assert texts(spark, path) == [] and not list(Path(tmp_path).rglob("*.json"))
    with pytest.raises(Exception, match="lost"):
        save(rows.coalesce(1), 8)
    fine = rows.where("photo_id < 7")
    with pytest.raises(Exception, match="7 notes instead of 8"):
        save(fine, 8)
    assert texts(spark, path) == []
    save(fine, 7)
    save(fine, 7)  # the same batch again: its files go
    assert len(texts(spark, path)) == 7 and len(json.loads(next(Path(tmp_path).rglob("*.json")).read_text())["files"]) == len(list(Path(tmp_path).rglob("*.parquet")))


# projects


def test_two_starts_at_once_make_one_project_and_two_runs(spark, tmp_path):
    def start(k):
        project = L.Project(spark, str(tmp_path), "old-letters")
        return project.ensure(), project.create_run({"start": k})

    with ThreadPoolExecutor(8) as pool:
        made = list(pool.map(start, range(8)))
    assert sum(first for first, _ in made) == 1 and len({run for _, run in made}) == 8
    base = tmp_path / "projects/old-letters"
    assert json.loads((base / "project.json").read_text())["name"] == "Old Letters" and len(list((base / "run-history").glob("*.json"))) == 8
    assert not L.create(spark, str(base / "project.json"), "{}") and json.loads((base / "project.json").read_text())["slug"] == "old-letters"


def test_runs_are_made_by_tasks_and_read_by_tasks(spark, tmp_path, monkeypatch):
    """A call to the driver for each run took over 400 s for 20,000."""
    from pagelake.sources import projects as H

    made = []
    monkeypatch.setattr(L, "create", lambda spark, path, text, create=L.create: made.append(path) or create(spark, path, text))
    monkeypatch.setattr(L.secrets, "randbits", lambda n: 4)  # another call draws the same digits
    monkeypatch.setattr(L, "datetime", SimpleNamespace(now=lambda tz: datetime(2026, 1, 2, 3, 4, 5, tzinfo=tz)))
    root = str(tmp_path)
    monkeypatch.setattr(L, "TASK_RUNS", 100)
    for call in range(2):
        L.create_runs(spark, root, spark.createDataFrame([(f"p{k % 3}", json.dumps({"part": k, "call": call}) if k + call else None) for k in range(600)], "slug string, metadata string"))
    assert sorted(made) == [f"{root}/projects/p{k}/project.json" for k in range(3)]
    (tmp_path / "projects/p0/run-history/notes.json").write_text("{}")
    (tmp_path / "projects/empty/run-history").mkdir(parents=True)
    got = [(r["slug"], r["file"], json.loads(r["value"])) for r in H.runs(spark, root).collect()]
    assert sorted((s, v.get("part", 0)) for s, _, v in got) == sorted((f"p{k % 3}", k) for k in range(600) for _ in range(2))
    assert len({(s, v["run_id"]) for s, _, v in got}) == 1200 and all(f == v["run_id"] + ".json" and v["layout_version"] == 1 for _, f, v in got)
    for at in (root, f"file://{root}"):
        assert sorted(map(tuple, H.projects(spark, at).collect())) == [(f"p{k}", f"P{k}", f"{root}/projects/p{k}") for k in range(3)] and H.runs(spark, at).count() == 1200


def test_a_repeated_task_finds_its_own_runs(tmp_path):
    from pyarrow.fs import LocalFileSystem

    path, store = str(tmp_path / "r.json"), LocalFileSystem()
    assert L._create_in_task(store, path, b"text") and L._create_in_task(store, path, b"text") and not L._create_in_task(store, path, b"other")
    Path(path).write_bytes(b"te")  # broken off
    assert not L._create_in_task(store, path, b"other") and L._create_in_task(store, path, b"text") and Path(path).read_bytes() == b"text"


def test_paths_follow_the_layout(spark, tmp_path):
    project = L.Project(spark, str(tmp_path), "p")
    project.ensure()
    assert L.stage_folder(spark, project.path, "raw_ocr") == f"{project.path}/pipeline/raw-ocr/text" and L.stage_folder(spark, project.path, "title", "records") == f"{project.path}/pipeline/titles/records"
    assert L.stage_folder(spark, f"{tmp_path}/old", "raw_ocr") == f"{tmp_path}/old/raw_ocr" and L.stage_folder(spark, f"{tmp_path}/old", "raw_ocr", "records") == f"{tmp_path}/old/raw_ocr/json"
    assert L.page_path(spark, project.path, "a/b") == f"{project.path}/pipeline/page/a/b.xml" and L.page_path(spark, f"{tmp_path}/old", "a") == f"{tmp_path}/old/page/a.xml"
    assert L.project_of(spark, f"{project.path}/pipeline/raw-ocr/text/x.txt") == project and L.project_of(spark, f"{tmp_path}/projects/none/x") is None
    assert project.stage("cleaned").endswith("/pipeline/cleaned")
    for call, name in ((project.stage, "raw_ocr"), (project.export, "zip")):
        with pytest.raises(ValueError, match=name):
            call(name)


# uploads


def test_upload_names_equal_one_after_the_other(spark):
    rng = random.Random(4)
    pool = ["a.jpg", "a_1.jpg", "a_3.jpg", "a_1_1.jpg", ".hidden", "b", "b_2", "x/../a.jpg", "..\\a.jpg", "..", "", "c.tar.gz"]
    names, taken = [rng.choice(pool) for _ in range(120)], ["a.jpg", "a_2.jpg", "a_7.jpg", "b_1", "c.tar_1.gz"]
    own = [Path(n.replace("\\", "/")).name for n in names]
    stem = lambda n: (Path(n).stem, Path(n).suffix)
    used = {*taken, *(n for n in own if n not in ("", ".", ".."))}
    given, expected = set(taken), []
    reserved = {n for n in used if (m := __import__("re").match(r"^(.*)_([1-9][0-9]*)$", stem(n)[0]))}
    for n in own:
        if n in ("", ".", ".."):
            expected.append(None)
            continue
        k = 0
        while (c := n if k == 0 else f"{stem(n)[0]}_{k}{stem(n)[1]}") in given or (k > 0 and c in reserved):
            k += 1
        given.add(c)
        expected.append(c)
    table = spark.createDataFrame([(k, n, 1) for k, n in enumerate(names)], "o int, name string, length long").repartition(5)
    got = {r["o"]: (r["saved_as"], r["status"]) for r in A.uploads(table, spark.createDataFrame([(t,) for t in taken], "name string"), "o").collect()}
    assert [got[k][0] for k in range(120)] == expected and {got[k][1] for k in range(120) if expected[k] is None} == {"invalid"}
    many = spark.range(60_000).select(F.col("id").alias("o"), F.lit("same.png").alias("name"), F.lit(1).alias("length"))
    out = A.uploads(many, spark.createDataFrame([("same_5.png",)], "name string"), "o")
    assert out.select("saved_as").distinct().count() == 60_000 and out.where("saved_as = 'same_60000.png'").count() == 1


# JSON


def tree_budget(text):
    """Depth, nodes and error from the whole tree."""
    try:
        level = [json.loads(text)]
    except ValueError:
        return 0, 0, "no JSON"
    if not isinstance(level[0], (dict, list)):
        return 0, 1, "scalar root"
    depth = nodes = 0
    while level:
        nodes += len(level)
        level = [v for n in level for v in (n.values() if isinstance(n, dict) else n) if isinstance(v, (dict, list))]
        depth += bool(level)
    return depth, nodes, "too many nodes" if nodes > J.MOST_NODES else "too deep" if depth > J.MOST_DEPTH else None


def test_scanner_agrees_with_a_parser():
    rng = random.Random(2)

    def value(d):
        kind = rng.randint(0, 7 if d < 6 else 4)
        return [1, -2.5e3, "a\"\\ü\n", None, True][kind] if kind < 5 else [value(d + 1) for _ in range(rng.randint(0, 4))] if kind < 7 else {f"k{i}\\": value(d + 1) for i in range(rng.randint(0, 4))}

    for _ in range(1500):
        text = json.dumps(value(0), ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
        assert J.budget(text) == tree_budget(text)
        cut = rng.randint(0, len(text))
        broken = text[:cut] + rng.choice(["", "]", "}", ",", ":", '"', "x", "01", "\t"]) + text[cut + rng.randint(0, 2) :]
        assert J.budget(broken) == tree_budget(broken), broken


def test_scanner_stops_early():
    import time
    import tracemalloc

    text = "[" * 33 + "]" * 33
    assert J.budget("[" * 33 + "]" * 33)[2] is None and J.budget("[" + text + "]")[2] == "too deep" and J.budget("[" * 10_000_000)[2] == "too deep"
    many = "[" + "{}," * 50_000 + "{}" + "]" * 20_000_000
    tracemalloc.start()
    start = time.time()
    assert J.budget(many)[1:] == (J.MOST_NODES + 1, "too many nodes")
    assert time.time() - start < 5 and tracemalloc.get_traced_memory()[1] < 20_000_000
    tracemalloc.stop()
    assert J.budget("\ufeff{}") == (0, 1, None) and J.budget("") == (0, 0, "no JSON") and J.budget("3 ") == (0, 1, "scalar root") and J.budget(" " * (J.MOST_BYTES + 1))[2] == "too large"


def test_canonical_text_is_null_where_broken(spark):
    df = spark.createDataFrame([(1, '{"b": 1, "a": "ü"}'), (2, "{"), (3, None)], "id int, t string")
    assert {r["id"]: r["c"] for r in df.select("id", J.canonical_json("t").alias("c")).collect()} == {1: '{"a":"ü","b":1}', 2: None, 3: None}


# images


def test_sizes_from_headers():
    for k in range(1, 200):
        data = made_file(k, k)
        full = I.image_size(data)
        assert (full is None) == (k % 6 > 3)
        if full:
            assert full[1:3] == (k + 1, 3 * k + 1)
            assert I.image_size(data + b"rest") == full and all(I.image_size(data[:n]) in (None, full, (*full[:3], 1)) for n in range(len(data)))
    assert I.image_size(None) is None and I.image_size(b"") is None and I.image_size(b"\xff\xd8\xff\xda") is None and I.image_size(b"%PDF-1.4") is None
    assert I.image_size(b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 0, 5)) is None


@pytest.mark.parametrize("degrees, scale", [(0, 1.0), (10, 1.0), (-10, 0.9), (5, 1.1), (-7, 1.05), (3, 0.95)])
def test_turned_scans_come_back_within_a_pixel(degrees, scale):
    sheet, scan = turned(3, degrees, scale)
    h, way, n = G.registered(sheet, scan, "features")
    height, width = sheet.shape
    a = np.deg2rad(degrees)
    points = np.array([[30, 30], [width - 30, 30], [30, height - 30], [width - 30, height - 30]], float)
    turn = scale * np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]])
    true = (points - [width / 2, height / 2]) @ turn.T + [width / 2, height / 2]
    assert way == "features" and n >= G.LEAST_MATCHES and np.hypot(*(G.put(h, points) - true).T).max() < 1


def test_what_does_not_belong_together_is_an_error():
    sheet, _ = turned(1, 0, 1.0)
    other, _ = turned(2, 0, 1.0)
    for scan in (other, np.full_like(sheet, 255), np.full((10, 10), 255, np.uint8)):
        with pytest.raises(ValueError, match="matches"):
            G.registered(sheet, scan, "features")
    with pytest.raises(ValueError, match="sizes differ"):
        G.registered(sheet, sheet[:-1], "shift")
    with pytest.raises(ValueError, match="no way"):
        G.registered(sheet, sheet, "sift")
    assert G.registered(sheet, I.moved(sheet, 2, -3))[1] == "shift"


def test_pages_are_dealt_over_tasks_and_drawn_a_few_at_a_time(spark, sf_dir, monkeypatch):
    """A table in one file was one task, which drew 10,000 pairs at once."""
    import pandas as pd

    from pagelake.plans import images as Q

    keys = pd.DataFrame({"p_partkey": range(1, 201)})
    drawn = list(Q._drawn(iter([keys])))
    assert max(map(len, drawn)) <= Q.AT_ONCE and [k for d in drawn for k in d["p_partkey"]] == list(range(1, 201))
    monkeypatch.setattr(Q, "TASK_PAGES", 50)
    assert Q.marks_on_scans(spark, sf_dir).rdd.getNumPartitions() == 4  # 200 parts


def test_turned_sheets_are_dealt_over_tasks_and_drawn_a_few_at_a_time(spark, sf_dir, monkeypatch):
    """Eight tasks drew all sheets, 10,000 pairs at once."""
    import pandas as pd

    from pagelake.plans import images as Q

    monkeypatch.setattr(Q, "AT_ONCE", 3)
    drawn = list(Q._turned(iter([pd.DataFrame({"s_suppkey": range(1, 9), "s_nationkey": 2})])))
    assert [len(d) for d in drawn] == [3, 3, 2] and [k for d in drawn for k in d["s_suppkey"]] == list(range(1, 9))
    monkeypatch.setattr(Q, "TASK_SHEETS", 1)
    assert Q.turned_scans(spark, sf_dir).rdd.getNumPartitions() == 10  # suppliers


def test_residual_equals_a_square_laid_on_each_pixel():
    rng = np.random.default_rng(2)
    for h, w in ((1, 1), (2, 9), (17, 12), (40, 31)):
        a, b = (np.kron(rng.integers(0, 2, (h, w)), np.ones((3, 2), int)) * 200 + rng.integers(0, 40, (3 * h, 2 * w)) for _ in range(2))
        a, b = a.clip(0, 255).astype(np.uint8), b.clip(0, 255).astype(np.uint8)
        d = np.abs(a.astype(int) - b)
        mask = d > I.DIFFERENT
        for op in (np.all, np.any, np.any, np.all):
            p = np.pad(mask, 1)
            mask = np.array([[op(p[y : y + 3, x : x + 3]) for x in range(mask.shape[1])] for y in range(mask.shape[0])])
        assert (I.residual(a, b) == np.where(mask, d, 0)).all()


def test_marks_on_a_turned_scan():
    sheet, (h, w) = turned(5, 0, 1.0)[0].copy(), (150, 120)
    sheet[55:80, 30:66] = 255
    c, s = np.cos(np.deg2rad(6)), np.sin(np.deg2rad(6))
    scan = G.warped(sheet, np.array([[c, -s, (w - c * w + s * h) / 2], [s, c, (h - s * w - c * h) / 2], [0, 0, 1]]), sheet.shape)
    scan[60:72, 40:56] = 0
    found = I.marks_of(sheet, scan, align=lambda r, s: G.aligned(r, s, "features"))
    assert any(abs(m["bbox"][0] - 40) <= 3 and abs(m["bbox"][1] - 60) <= 3 for m in found)


@pytest.mark.parametrize("k", [20574, 20509, 20424])
def test_angles_of_scans_are_exact_to_a_tenth_of_a_degree(k):
    """By corners alone these were 0.44, 0.43 and 0.41 degrees off, nearly a whole degree when rounded."""
    h, _, _ = G.registered(*turned(k, k % 21 - 10, 1.1), "features")
    at, side = G.put(h, np.array([[60.0, 75.0], [61.0, 75.0]]))
    assert abs(np.degrees(np.arctan2(*(side - at)[::-1])) - (k % 21 - 10)) < 0.1 and np.hypot(*(at - [60, 75])) < 0.1


def test_pages_as_expressions_have_the_bytes_of_rendered_ones(spark):
    import datetime as dt

    from pyspark.sql import types as T

    from pagelake.plans.files import _PAGE
    from pagelake.sinks.pagexml import page_xml, render

    kind, when, odd = T._parse_datatype_string(_PAGE), dt.datetime(2026, 1, 2, 3, 4, 5), 'a&<>"\r\n\tä '
    point, equiv = [{"x": 1, "y": -2}, None, {"x": 3, "y": 4}], [{"index": 2, "unicode": odd}, {"index": 0, "unicode": None}, {"index": 0, "unicode": ""}]
    line = {"id": "l1", "polygon": point, "baseline": point[:1], "equivs": equiv}
    regions = [{"id": odd if k else "r0", "type": "" if k == 1 else "other", "custom": odd if k else None, "polygon": point[:k], "confidence": c, "equivs": equiv[:k], "lines": [line, {**line, "baseline": []}][:k]} for k, c in enumerate((0.5, None, 1e-05, 0.0001, 0.000123, 0.99))]
    full = {"image_filename": odd, "image_width": 5, "image_height": 7, "creator": odd, "created": when, "last_change": when.replace(microsecond=1200), "steps": [{"name": "n", "value": odd, "date": when}, {"name": "m", "value": "v", "date": None}], "regions": regions, "reading_order": ["x", odd], "group_id": "g", "pc_gts_id": odd}
    pages = [full, {**full, "reading_order": [], "group_id": None, "pc_gts_id": None, "steps": []}, {**full, "regions": [], "reading_order": [], "creator": None}, {**full, "regions": regions[:1], "reading_order": None, "group_id": ""}]
    df = spark.createDataFrame([(k, p) for k, p in enumerate(pages)], T.StructType([T.StructField("k", T.IntegerType()), T.StructField("p", kind)]))
    got = {r["k"]: bytes(r["x"]) for r in df.select("k", page_xml(F.col("p"), kind).alias("x")).collect()}
    for k, p in enumerate(pages):
        assert got[k].decode() == render(p).decode()
