import difflib
import re
import unicodedata

from hypothesis import Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagelake.functions import text as T
from pagelake.functions import udf as U
from pagelake.functions.repair import LOWER, PREFIXES, UPPER, repair

ODD = "aBäÉß 1_-.,;:!?\n\r\t—„“  \x1c½²ⅧЖ文'\"&<>|\\"
TEXTS = st.lists(st.text(alphabet=ODD, max_size=60), min_size=40, max_size=60)


def rows(spark, texts, *columns):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r.asDict() for r in df.select("i", *columns).orderBy("i").collect()]


@settings(max_examples=2, deadline=None, derandomize=True, phases=[Phase.generate])
@given(TEXTS)
def test_tokens_follow_letter_classes(spark, texts):
    got = rows(spark, texts, T.words(F.col("text")).alias("w"), T.ngram_tokens(F.col("text")).alias("n"))
    for t, g in zip(texts, got, strict=True):
        assert g["w"] == re.findall(r"[^\W\d_]+", t)
        assert g["n"] == re.findall(r"[^\W_]+", t)


@settings(max_examples=2, deadline=None, derandomize=True, phases=[Phase.generate])
@given(TEXTS)
def test_proper_nouns_skip_sentence_starts(spark, texts):
    texts = [t + " Haus die Straße Elsass. Berlin: Köln" for t in texts]
    for t, g in zip(texts, rows(spark, texts, T.proper_nouns(F.col("text")).alias("p")), strict=True):
        found = [m for m in re.finditer(r"[^\W\d_]+", t) if len(m[0]) >= 4 and m[0][0].isupper()]
        assert g["p"] == [m[0] for m in found if t[max(0, m.start() - 2) : m.start()].strip() not in ("", ".", "!", "?", ":", ";")]


def test_repair_counts_each_rule(spark):
    letters = LOWER + UPPER
    cases = {
        "Be-\nricht": ("Bericht", "hyphen_rejoin"), "Kaiser-\r\nWilhelm": ("Kaiser-Wilhelm", "hyphen_keep"), "self-\nevident": ("self-evident", "hyphen_prefix_keep"), "care-\nful": ("careful", "hyphen_rejoin"),
        "eggs— \n there": ("eggs—there", "emdash_break_join"), "und,\nteil": ("und, teil", "line_break_join"), "a  b": ("a b", "spaces_collapsed"), "so , da": ("so, da", "space_before_punct"), "---\nx: 1\n---\nText": ("Text", "front_matter_stripped"),
    }
    df = spark.createDataFrame([(t,) for t in [*cases, None, "", "1-\nb", "End.\nnext", "---\nno end"]], "text string")
    got = {r["text"]: r for r in repair(df).collect()}
    for t, (want, rule) in cases.items():
        assert got[t]["repaired"] == want, t
        assert int(got[t][rule]) == 1, (t, rule)
    for t in ("", "1-\nb", "End.\nnext", "---\nno end"):
        assert got[t]["repaired"] == t
    assert got[None]["repaired"] is None
    assert re.match(rf"[{letters}]", "ü") and len(PREFIXES) == 13


def test_guards(spark):
    loop, prose = "the same again\n" * 50, "\n".join(f"line {i} is new" for i in range(40))
    phrase = "round and round it goes " * 60
    dates = " ".join(f"In {1900 + i} we sold {i} kg." for i in range(60))
    texts = [loop, prose, phrase, dates, "", " \n ", "short", "a\nb\nc\n" * 15]
    d = T.repetition_reason(F.col("text"), T.ngram_tokens(F.col("text")), T.lines(F.col("text"))).alias("r")
    assert [g["r"] for g in rows(spark, texts, d)] == ["lines", None, "ngrams", None, "empty", "empty", None, "lines"]


def test_confidence_is_truncated_double_arithmetic(spark):
    texts = ["word " * 100, "perhaps torn [unclear] " + "word " * 97, "...", "illegible " * 10, ""]
    got = rows(spark, texts, T.marker_count(F.col("text")).alias("m"), T.heuristic_score(T.marker_count(F.col("text")), T.word_count(F.col("text"))).alias("s"))
    for t, g in zip(texts, got, strict=True):
        m = sum(min(3, t.lower().count(x)) for x in T.MARKERS)
        assert g["m"] == m and g["s"] == max(0, int(100 * (1 - m / max(len(t.split()), 1) / 0.05)))
    pairs = spark.createDataFrame([(h, m) for h in range(101) for m in (0, 1, 50, 99, None)], "h int, m int")
    for r in pairs.withColumn("o", T.overall_score(F.col("h"), F.col("m"))).collect():
        assert r["o"] == int(0.6 * r["h"] + 0.4 * (50 if r["m"] is None else r["m"]))


@settings(max_examples=60, deadline=None, derandomize=True)
@given(st.lists(st.sampled_from("ab cd\nef "), max_size=25), st.lists(st.sampled_from("ab cd\nef "), max_size=25))
def test_changed_ranges_cover_what_differs(a, b):
    a, b = "".join(a), "".join(b)
    found = U.changed_ranges(a, b)
    whole = "".join(re.findall(r"\S+\s*", a))
    kept = [w for i, w in enumerate(whole) if not any(s <= i < e for s, e, _ in found["raw"])]
    same = difflib.SequenceMatcher(a=a.split(), b=b.split(), autojunk=False)
    assert "".join(kept).split() == [w for m in same.get_matching_blocks() for w in a.split()[m.a : m.a + m.size]]


@settings(max_examples=40, deadline=None, derandomize=True)
@given(st.lists(st.text(alphabet="ab. \n", min_size=1, max_size=80), max_size=30), st.integers(3, 20))
def test_chunks_lose_no_word_and_fit(parts, limit):
    text = "\n\n".join(parts)
    room = int(limit * 3.5)
    got = U.chunks(text, limit, 0)
    assert " ".join(got).split() == text.split() or got == [text]
    for c in got:
        assert len(c) <= room + 3 or len(c.split()) <= 1 or c == text


def test_overlap_repeats_the_tail(spark):
    text = "\n\n".join(f"paragraph {i} " + "x" * 40 for i in range(10))
    with_tail, without = U.chunks(text, 30, 5), U.chunks(text, 30, 0)
    assert len(with_tail) >= len(without) > 1
    assert all(b.startswith(a[-17:]) for a, b in zip(with_tail, with_tail[1:], strict=False))
    df = spark.createDataFrame([(1, text), (2, "fits"), (3, "")], "doc_id long, text string")
    c = U.chunk_rows(df, max_tokens=30, dedupe=True).groupBy("doc_id").agg(U.reassembled().alias("t"))
    assert {r["doc_id"]: r["t"].split() for r in c.collect()} == {1: text.split(), 2: ["fits"], 3: []}


def test_names(spark):
    got = rows(spark, ["a/b:c?. ", " .. ", None, "x" * 200, "  two  words "], T.safe_name(F.col("text")).alias("s"))
    assert [g["s"] for g in got] == ["a_b_c_", "untitled", "untitled", "x" * 120, "two words"]
    got = rows(spark, ["Größe & Maß", "--a__b--", "", "Ünï code"], T.slug(F.col("text")).alias("s"))
    assert [g["s"] for g in got] == ["größe-maß", "a-b", "", "ünï-code"]
    got = rows(spark, ["page10", "page2", "Page2b"], T.natural_key(F.col("text")).alias("k"))
    assert sorted(range(3), key=lambda i: got[i]["k"]) == [1, 2, 0]
    got = rows(spark, ["DE, en", "german", " fr ", "d3", ""], T.language_name(T.language_code(F.col("text"))).alias("n"))
    assert [g["n"] for g in got] == ["German", "unknown", "French", "unknown", "unknown"]
    assert unicodedata.normalize("NFC", "ü") == "ü"


def test_like_folds_ascii_only(spark):
    got = rows(spark, ["ÄPFEL", "äpfel", "aPFEL", "50%x", "a\\b"], T.ascii_ilike(F.col("text"), F.lit("%äpfel%")).alias("l"), T.ascii_ilike(F.col("text"), F.lit("%A\\B%")).alias("b"))
    assert [g["l"] for g in got] == [False, True, False, False, False]
    assert [g["b"] for g in got] == [False, False, False, False, True]
