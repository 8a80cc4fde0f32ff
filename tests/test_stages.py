"""Stages around models: every page comes out once, every call is made once."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagelake.effects import stages as S
from pagelake.store import scope, shared_dir, stash, sweep


@pytest.fixture
def calls(tmp_path):
    """note(...) is a call that a model was given; calls() counts them, from whatever process."""
    folder = tmp_path / "calls"
    folder.mkdir()

    def note(*what):
        import uuid

        (folder / uuid.uuid4().hex).write_text(repr(what))

    return note, lambda: Counter(p.read_text() for p in folder.iterdir())


LOOP = "again\n" * 40


def test_ladder_sees_each_page_once_a_rung(spark, calls):
    note, counted = calls

    def vision(texts, temperature):
        for t in texts:
            note(t, temperature)
        if any(t == "torn" for t in texts):
            raise ValueError("unreadable")
        return [LOOP if t.startswith("loop") and temperature < float(t[4:]) else f"{t} read" for t in texts]

    rows = [(1, "a", False), (1, "loop0.3", False), (None, "loop9", False), (2, "b", None), (None, "torn", False), (3, "c", True), (4, None, False), (1, "loop0.3", False)]
    pages = spark.createDataFrame(rows, "doc_id long, image string, blank boolean").repartition(3)
    good, bad = S.read_pages(pages, vision, temperatures=S.ladder())
    got = Counter((r["doc_id"], r["text"], r["engine"], r["attempts"]) for r in good.collect())
    assert got == Counter([(1, "a read", "vision", 1), (1, "loop0.3 read", "vision", 3), (1, "loop0.3 read", "vision", 3), (2, "b read", "vision", 1), (3, "", "blank", 0), (4, " read", "vision", 1)])
    assert Counter((r["doc_id"], r["reason"], r["error"], r["attempts"]) for r in bad.collect()) == Counter([(None, "lines", None, 8), (None, "error", "ValueError: unreadable", 1)])
    said = counted()
    assert said[repr(("loop9", 0.8))] == 1 and said[repr(("loop0.3", 0.1))] == said[repr(("loop0.3", 0.3))] == 2 and said[repr(("loop0.3", 0.4))] == 0
    assert said[repr(("a", 0.1))] <= 2 and sum(v for k, v in said.items() if k.startswith("('a'")) <= 2  # a batch that fails is tried row by row


def test_second_engine(spark):
    pages = spark.createDataFrame([(k, t, False) for k, t in enumerate(["fine", "loop", "torn", "loop twice", "torn blank", "torn loop"])], "doc_id long, image string, blank boolean")

    def vision(texts):
        if any("torn" in t for t in texts):
            raise ValueError("unreadable")
        return [LOOP if "loop" in t else t for t in texts]

    def second(texts):
        return [LOOP if t in ("loop twice", "torn loop") else " " if "blank" in t else f"second {t}" for t in texts]

    good, bad = S.read_pages(pages, vision, second)
    assert {(r["doc_id"], r["text"], r["engine"]) for r in good.collect()} == {(0, "fine", "vision"), (1, "second loop", "fallback"), (2, "second torn", "fallback")}
    assert {(r["doc_id"], r["reason"], r["error"], (r["rejected_text"] or "")[:5]) for r in bad.collect()} == {(3, "lines", None, "again"), (4, "error", "ValueError: unreadable", ""), (5, "lines", None, "again")}


def test_no_rungs_and_no_guard(spark):
    pages = spark.createDataFrame([(1, "x", False)], "doc_id long, image string, blank boolean")
    good, bad = S.read_pages(pages, lambda ts, t: ts, temperatures=[])
    assert good.count() == 0 and [r["reason"] for r in bad.collect()] == ["no temperature"]
    good, bad = S.read_pages(pages, lambda ts: [LOOP] * len(ts), guard=False)
    assert bad.count() == 0 and good.first()["text"] == LOOP
    none = S.read_pages(pages.limit(0), lambda ts: ts, lambda ts: ts)
    assert [d.count() for d in none] == [0, 0]


@pytest.mark.parametrize("step, most, n", [(0.1, 0.8, 8), (-0.1, 0.8, 50), (0, 9, 50), (float("nan"), 0.8, 50), (0.1, float("inf"), 50), (0.1, 0.05, 0)])
def test_ladder_always_ends(step, most, n):
    assert len(S.ladder(step=step, most=most)) == n


def test_translation_calls_each_model_once(spark, calls):
    note, counted = calls

    def model(name, answer):
        def run(texts):
            for t in texts:
                note(name, t)
            return [answer(t) for t in texts]

        return run

    pages = spark.createDataFrame([(1, "eins"), (1, "zwei"), (None, "drei"), (2, "an English one")], "doc_id long, text string").repartition(2)
    out = S.translate(pages, model("detect", lambda t: "en" if "English" in t else "de"), model("translate", lambda t: f"said {t}"), model("assess", lambda t: "90"))
    assert Counter((r["doc_id"], r["translated"], r["score"]) for r in out.collect()) == Counter([(1, "said eins", 96), (1, "said zwei", 96), (None, "said drei", 96), (2, "an English one", None)])
    assert out.count() == 4 and counted() == Counter({repr(("detect", t)): 1 for t in ("eins", "zwei", "drei", "an English one")} | {repr(("translate", t)): 1 for t in ("eins", "zwei", "drei")} | {repr(("assess", f"{t} said {t}")): 1 for t in ("eins", "zwei", "drei")})


def test_titles_of_rows_that_share_an_id(spark):
    pages = spark.createDataFrame([(1, "a", "s1"), (1, "b", "s2"), (None, "c", "s3"), (None, None, "s4")], "doc_id long, text string, stem string")
    got = S.titles(pages, lambda ts: [f'{{"title": "About {t} é"}}' if t else "x" for t in ts]).collect()
    assert Counter((r["doc_id"], r["title"], r["accent_warning"], r["error"]) for r in got) == Counter([(1, "About a é", True, None), (1, "About b é", True, None), (None, "About c é", True, None), (None, "s4", False, "no JSON with a title")])


def test_structure_goes_on_where_it_stopped(spark, calls):
    note, counted = calls

    def model(texts):
        for t in texts:
            note(t)
        return texts

    pages = spark.createDataFrame([(1, "a b"), (2, "c d"), (None, "e f")], "doc_id long, text string")
    done = spark.createDataFrame([(1, "kept", True), (None, "no", True)], "doc_id long, structured string, ok boolean")
    assert {(r["doc_id"], r["structured"]) for r in S.structure(pages, model, done).collect()} == {(1, "kept"), (2, "c d"), (None, "e f")}
    assert counted() == Counter({repr(("c d",)): 1, repr(("e f",)): 1})


def test_clean_without_its_guard(spark):
    pages = spark.createDataFrame([(1, "A long page.")], "doc_id long, text string")
    assert S.clean(pages, lambda ts: ["Short"] * len(ts)).first()["cleaned"] == "A long page."
    assert S.clean(pages, lambda ts: ["Short"] * len(ts), guard=False).first()["cleaned"] == "Short"


def test_models_fall_back_but_never_guess_sight(spark):
    have = spark.createDataFrame([("z-embed", 0), ("b:1", 1), ("a-1", 2), ("b-1", 3)], "name string, ord int")
    want = spark.createDataFrame([("chat", "none", 0, False), ("vision", "a-1", 0, False), ("embedding", "x", 0, False), ("ocr", "b-1", 0, True), ("translation", "a:1", 5, False)], "role string, name string, ord int, vision boolean")
    got = {r["role"]: (r["model"], r["how"]) for r in S.resolve_model(have, want).collect()}
    assert got == {"chat": ("b:1", "fallback"), "vision": (None, "none"), "embedding": ("z-embed", "fallback"), "ocr": ("b-1", "recommended"), "translation": ("a-1", "recommended")}
    assert {(r["model"], r["how"]) for r in S.resolve_model(have, want, "b-1").collect()} == {("b-1", "user")}
    assert {(r["model"], r["how"]) for r in S.resolve_model(have.limit(0), want).collect()} == {(None, "none")}
    assert {r["how"] for r in S.resolve_model(have, want, "gone").collect()} == {"configured_missing"}


def test_tables_go_with_their_scope(spark):
    from pathlib import Path

    with scope(spark) as folder:
        assert stash(spark.range(3), "x").count() == 3 and Path(folder).exists()
    assert not Path(folder).exists()
    kept = stash(spark.range(3).withColumn("y", F.lit(1)), "kept")
    assert sweep(spark, 1) == 0 and kept.count() == 3 and Path(shared_dir(spark)).exists()
