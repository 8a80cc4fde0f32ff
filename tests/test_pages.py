"""Operators on a run's pages, and the rules that queries alone don't show."""

import difflib
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from pagelake.effects import stages as S
from pagelake.functions import image as I
from pagelake.functions import text as T
from pagelake.functions import udf as U
from pagelake.operators import catalog as C
from pagelake.operators import collect as X
from pagelake.operators import pages as P
from pagelake.plans import QUERIES
from pagelake.sources import files as A


def test_small_rules(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first()["x"]
    assert [(p["x"], p["y"]) for p in get(P.full_page(F.lit(4), F.lit(7)))] == [(0, 0), (4, 0), (4, 7), (0, 7)] and get(P.full_page(F.lit(0), F.lit(7))) is None
    assert [get(P.percent(F.lit(x))) for x in (0.125, 0.135, 1.0)] == ["12%", "14%", "100%"]
    assert get(P.engine_label(F.array(F.lit("a"), F.lit("b"), F.lit("a")))) == "a+b" and get(P.engine_label(F.array().cast("array<string>"))) == "vision"
    assert get(P.prompt_of(F.lit("formal"))) != get(P.prompt_of(F.lit("odd"))) == get(P.prompt_of(F.lit(None).cast("string"))) == get(P.prompt_of(F.lit("default")))
    assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(Z|[+-]\d\d:\d\d)", get(P.utc_now()))
    assert [get(P.closed_states(F.lit(s), F.lit(c))) for s, c in (("running", True), ("pending", False), ("done", True))] == ["cancelled", "skipped", "done"]
    assert get(P.union_of(F.array(F.lit(2), F.lit(1)), F.array(F.lit(3), F.lit(2)))) == [2, 1, 3]
    names = F.array(F.lit("Box/a"), F.lit("Box/b"))
    assert get(X.batch_name(names, F.lit("20200101-1200"))) == "Box-20200101-1200"
    assert get(X.batch_name(F.array(F.lit("Box/a"), F.lit("b")), F.lit("m"))) == "batch-m" == get(X.batch_name(F.array(F.lit("a"), F.lit("b")), F.lit("m"))) == get(X.batch_name(F.array(F.lit("a/x"), F.lit("b/x")), F.lit("m")))
    long = [get(T.natural_key(F.lit(x))) for x in ("p" + "1" * 25, "p" + "9" * 20, "p007", "p8")]
    assert sorted(range(4), key=lambda i: long[i]) == [2, 3, 1, 0]
    assert [get(T.positive_int(F.lit(x))) for x in ("4", "0", "x", "-1")] == [4, None, None, None]
    assert get(C.contained(F.lit("/a/b/../c"), F.lit("/a"))) and not get(C.contained(F.lit("/ab"), F.lit("/a")))


def test_lines_find_their_regions(spark):
    points = "array<struct<x:int,y:int>>"
    lines = spark.createDataFrame([(1, 0, ["zz", "b"], [(0, 0), (9, 1)], None), (1, 1, [], None, [(5, 5), (7, 8)]), (1, 2, ["b", "a"], [(1, 1)], None), (1, 3, None, [], None), (1, 4, ["q"], [(2, 9)], None), (2, 0, ["a"], [(3, 3)], None)], f"page int, pos int, region_ids array<string>, boundary {points}, baseline {points}")
    regions = spark.createDataFrame([(1, 0, "a", "text", [(0, 0)]), (1, 1, "b", "text", [(1, 1)]), (3, 0, "a", "text", [(0, 0)])], f"page int, nth int, id string, type string, boundary {points}")
    got = {(r["page"], r["region"]): (r["order"], r["lines"], [(p["x"], p["y"]) for p in r["polygon"]]) for r in P.lines_to_regions(lines, regions).collect()}
    assert got == {
        (1, "kraken-0002"): (0, ["kraken-line-0001", "kraken-line-0003"], [(1, 1)]), (1, "kraken-0003"): (1, ["kraken-line-0002", "kraken-line-0004"], [(2, 5), (7, 5), (7, 9), (2, 9)]),
        (1, "kraken-0001"): (2, [], [(0, 0)]), (2, "kraken-0001"): (0, ["kraken-line-0001"], [(3, 3), (3, 3), (3, 3), (3, 3)]), (3, "kraken-0001"): (0, [], [(0, 0)]),
    }


def test_lines_and_regions_are_dealt_once(spark, sf_dir):
    """Each side is shuffled by page before they meet, and no row again: two exchanges, no join."""
    plan = QUERIES["lines_in_regions"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan


def test_titles_are_stripped_and_blank_ones_fall_back(spark):
    items = spark.createDataFrame([(i,) for i in range(1, 6)], "id long")
    values = spark.createDataFrame([(1, C.TITLE_PROPERTIES[0], "  Spaced \n"), (2, C.TITLE_PROPERTIES[0], " "), (2, C.TITLE_PROPERTIES[1], "other"), (3, "x", "no title")], "id long, property string, text string")
    photos = spark.createDataFrame([(2, 7, 1, " f.jpg "), (2, 8, None, None), (3, 9, 1, "g.jpg"), (3, 4, 1, "h.jpg"), (4, 5, 0, "")], "item_id long, photo_id long, position int, filename string")
    assert {r["id"]: r["title"] for r in C.titles(items, values, photos).collect()} == {1: "Spaced", 2: "Item 2", 3: "h.jpg", 4: "Item 4", 5: "Item 5"}


def test_uploads_never_share_a_name(spark):
    files = spark.createDataFrame([(1, "a.jpg", 1), (2, "a_1.jpg", 1), (3, "a.jpg", 1), (4, "a.jpg", 1), (5, "b", 1), (6, "a_1.jpg", 1)], "o int, name string, length long")
    got = {r["o"]: r["saved_as"] for r in A.uploads(files, spark.createDataFrame([("b",), ("b_1",), ("a_2.jpg",)], "name string"), "o").collect()}
    assert got == {1: "a.jpg", 2: "a_1.jpg", 3: "a_3.jpg", 4: "a_4.jpg", 5: "b_2", 6: "a_1_1.jpg"}


def test_rows_that_share_an_id_keep_their_texts(spark):
    pages = spark.createDataFrame([(1, "Erster Text hier."), (1, "Zweiter Text dort."), (1, "Erster Text hier."), (None, "Dritter Text.")], "doc_id long, text string")
    got = Counter((r["doc_id"], r["cleaned"]) for r in S.clean(pages, lambda ts: ts).collect())
    assert got == Counter((d, t) for d, t in pages.collect())
    rated = S.translate(pages, lambda ts: ["de"] * len(ts), lambda ts: ["said " + t for t in ts], lambda ts: ["50 out of 100" if "Erster" in t else "x" for t in ts]).collect()
    assert Counter((r["doc_id"], r["translated"], r["score"]) for r in rated) == Counter((d, "said " + t, 80) for d, t in pages.collect())
    seen = []
    names = pages.withColumn("text", F.repeat("text", F.lit(500))).withColumn("stem", F.lit("s"))
    assert S.titles(names.limit(1), lambda ts: [f'{{"title": "{len(t)} characters here"}}' for t in ts]).first()["title"] == "2000 characters here" and not seen


def test_lighting_is_divided_out():
    ramp = np.tile(np.linspace(60, 240, 200), (120, 1))
    page = ramp.copy()
    page[40:60, 20:180:8] *= 0.4
    flat = I.flattened(page.astype(np.uint8))
    paper = flat[5, 20:180].astype(float)
    assert paper.max() - paper.min() < 40 < ramp[5, 20:180].max() - ramp[5, 20:180].min() and flat[50, 28] < 0.6 * flat[5, 28]


def test_cleanup_verdict_by_plain_python(spark, sf_dir):
    from pagelake.plans.text import _pairs

    words = re.compile(r"[^\W\d_]+")
    nouns = lambda t: Counter(m[0] for m in words.finditer(t) if len(m[0]) >= 4 and m[0][0].isupper() and t[max(0, m.start() - 2) : m.start()].strip() not in ("", ".", "!", "?", ":", ";"))
    got = {r["doc_id"]: r for r in QUERIES["cleanup_guard"](spark, sf_dir).collect()}
    pairs = _pairs(spark, sf_dir).collect()
    assert len(got) == len(pairs)
    for doc_id, a, b in ((r["doc_id"], r["raw"], r["cleaned"]) for r in pairs):
        x, y = words.findall(a), words.findall(b)
        gone = sum(j - i for op, i, j, *_ in difflib.SequenceMatcher(a=x, b=y, autojunk=False).get_opcodes() if op == "delete")
        ratio = sum(map(len, y)) / sum(map(len, x)) if x else 1.0
        lost = sorted((nouns(a) - nouns(b)).keys())
        accents = bool(re.search(f"[{T.ACCENTS}]", b)) and not re.search(f"[{T.ACCENTS}]", a)
        ok = bool(b.strip()) and gone <= 2 and ratio >= 0.97 and not lost and not accents
        r = got[doc_id]
        assert (r["ok"], r["nouns_dropped"], r["kept"]) == (ok, lost[:20], b if ok else a)
        assert (r["words_deleted"], r["length_ratio"]) == ((gone, round(ratio, 4)) if b.strip() else (None, None))


def test_diff_ranges_of_the_table_by_plain_python(spark, sf_dir):
    import json

    from pagelake.plans.text import _pairs

    got = {r["doc_id"]: r for r in QUERIES["diff_ranges"](spark, sf_dir).collect()}
    for r in _pairs(spark, sf_dir).collect():
        for side in ("raw", "cleaned"):
            found = json.loads(got[r["doc_id"]][f"{side}_ranges"])
            whole = "".join(re.findall(r"\S+\s*", r[side]))
            last = 0
            for f in found:
                assert last <= f["start"] < f["end"] <= len(whole) and f["tag"] in ("replace_", "delete_", "insert_")
                last = f["end"]
    assert U.lost_nouns("der Alte Berg", "der Berg") == ["Alte"]


def test_chunks_of_the_table_lose_no_word(spark, sf_dir):
    from pagelake.plans.text import _pages

    texts = {r["doc_id"]: r["text"] or "" for r in _pages(spark, sf_dir).collect()}
    n = Counter(r["doc_id"] for r in QUERIES["chunk_pages"](spark, sf_dir).collect())
    r = U.chunk_rows(_pages(spark, sf_dir), dedupe=True).groupBy("doc_id").agg(U.reassembled().alias("t")).collect()
    assert {x["doc_id"]: x["t"].split() for x in r} == {k: t.split() for k, t in texts.items()}
    assert all((n[k] > 1) == (int(len(t) / 3.5) > 3500) for k, t in texts.items())
