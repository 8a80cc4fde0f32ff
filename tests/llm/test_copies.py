"""The n-gram Jaccard join and the mix on hard tables: hubs, hot passages, shared ids, tiles, ties."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_llm import brute_components, near_copies

from pagelake.llm import components, jaccard, mixing, text
from pagelake.llm.components import connected_components


def near(rng, base, changes):
    words = list(base)
    for _ in range(changes):
        words[rng.integers(0, len(words))] = f"z{rng.integers(0, 10**6)}"
    return " ".join(words)


def join(spark, rows, parts=3):
    return Counter(map(tuple, jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()))


def test_one_id_with_two_texts_links_both(spark):
    rng = np.random.default_rng(0)
    long = [f"l{i}" for i in range(300)]
    rows = [(1, "a b c d e f g"), (5, "a b c d e f g"), (5, " ".join(long)), (9, near(rng, long, 1)), (7, near(rng, long, 2)), (None, " ".join(long)), (8, "q")]
    assert join(spark, rows) == brute_components(rows)
    assert {(r["doc_id"], r["component_id"]) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()} >= {(9, 1), (7, 1), (None, 1)}


def test_ids_of_all_sizes_have_components(spark):
    rows = [((1 << 62) + 5, "a b c"), ((1 << 63) - 1, "a b c"), (-(1 << 63), "x y z"), (-3, "x y z"), ((1 << 62) + 1, "alone here")]
    assert join(spark, rows) == brute_components(rows)


def test_long_words_hash_by_all_their_bytes():
    for n in (4095, 4096, 8192, 3 << 20):
        a, b = (text.folded_hashes(x) for x in (b"a" + b"x" * n + b"b", b"b" + b"x" * n + b"a"))
        assert len(a) == len(b) == 1 and a[0] != b[0]


def test_join_over_tiles_of_few_sets(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE_SETS", 3)
    monkeypatch.setattr(jaccard, "CHUNK", 50)
    rows = near_copies(4)
    rng = np.random.default_rng(4)  # a chain: neighbours link, ends don't
    words = [f"c{i}" for i in range(200)]
    for k in range(40):
        rows.append((2000 + k, " ".join(words)))
        at = int(rng.integers(0, 190))
        words[at : at + 3] = [f"n{k}.{i}" for i in range(3)]
    assert join(spark, rows) == brute_components(rows)


def test_groups_left_open_by_the_tied_tiles(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE_SETS", 2)
    monkeypatch.setattr(jaccard, "grid", lambda n: 64)  # loose bounds, so groups hold what doesn't link
    rng = np.random.default_rng(9)
    rows = [(int(k), near(rng, [f"w{i}" for i in range(150)], int(rng.integers(0, 9)))) for k in rng.permutation(60)]
    assert join(spark, rows) == brute_components(rows)


def test_frequent_passages_come_last_and_lose_no_link(spark):
    rng = np.random.default_rng(5)
    passage, rows = [f"p{i}" for i in range(30)], []
    for k in range(1500):
        own = [f"o{k % 700}.{i}" for i in range(int(rng.integers(0, 3)) * 12)]
        rows.append((k, " ".join(passage + own + [f"t{k}"] * (k % 3 == 0))))
    s = jaccard._Solved(spark.createDataFrame(rows, "doc_id long, text string"), 80, 5)
    assert len(s.hot[0]) >= 5  # shingles of the passage
    assert join(spark, rows) == brute_components(rows)


def test_blocks_meet_under_any_order_of_frequent_shingles():
    rng, similar = np.random.default_rng(1), jaccard.Similar()
    for _ in range(300):
        n = int(rng.integers(1, 300))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        gone = int(rng.integers(0, similar.differ(len(a)) + 1))
        b = np.unique(np.concatenate([rng.permutation(a)[gone:], rng.integers(0, 1 << 63, similar.differ(len(a)) - gone, dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        hot = np.unique(rng.choice(a, int(rng.integers(1, len(a) + 1))))
        order = hot, rng.permutation(len(hot))
        if 100 * both >= 80 * (len(a) + len(b) - both) and not np.array_equal(a, b):
            assert len(np.intersect1d(jaccard.blocks_of(a, similar, order), jaccard.blocks_of(b, similar, order)))


def test_members_of_blocks_meet_at_their_leader():
    rng = np.random.default_rng(2)
    blocks = {int(b): set(rng.choice(30, int(rng.integers(1, 15)), replace=False).tolist()) for b in rng.integers(-(1 << 60), 1 << 60, 60)}
    rows = sorted((b, v) for b, x in blocks.items() for v in x for _ in range(int(rng.integers(1, 3))))
    cut = sorted({0, len(rows), *rng.integers(0, len(rows), 25).tolist()})
    batches = [pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows[i:j]], pa.int64()), pa.array([v for _, v in rows[i:j]], pa.int64())], names=["block", "key"]) for i, j in zip(cut, cut[1:])]
    got = {(b, v) for out in jaccard._shared(iter(batches)) for b, v in zip(*(c.to_pylist() for c in out.columns))}
    assert got == {(min(x), v) for x in blocks.values() if len(x) > 1 for v in x}


def test_a_large_group_gives_a_row_for_each_member():
    rng, similar = np.random.default_rng(3), jaccard.Similar()
    base = np.unique(rng.integers(0, 1 << 64, 100, dtype=np.uint64))
    for m in (100, 400):
        sets = [np.unique(np.append(rng.permutation(base)[:97], rng.integers(0, 1 << 64, 3, dtype=np.uint64))) for _ in range(m)]
        cols = [[1] * m, [0] * m, [0] * m, list(range(m)), [len(s) for s in sets]]
        batch = pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.array(map(jaccard._packed, sets), pa.binary())], names=["block", "low", "high", "key", "n", "counts"])
        assert sum(b.num_rows for b in jaccard._search_blocks(similar)(iter([batch]))) == m - 1


def test_components_with_hubs(spark, monkeypatch):
    monkeypatch.setattr(components, "HUB", 5)
    edges = [(500, i) for i in range(60)] + [(i, i + 1) for i in range(100, 130)] + [(200, 100), (59, 40)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in [*range(60), 500]} | {i: 100 for i in [*range(100, 131), 200]}


EXTRA = "doc_id long, text string, set_name string, other_doc_id long, stay_id long, comp string, lang string"


def test_one_of_each_group_stays(spark):
    rng = np.random.default_rng(6)
    a, b = ([f"{c}{i}" for i in range(120)] for c in "ab")
    texts = [(3, " ".join(a)), (3, " ".join(a)), (3, " ".join(b)), (5, near(rng, b, 1)), (None, near(rng, a, 1)), (None, "only here"), (None, "only here"), (None, None), (None, None), (8, ""), (9, "solo text"), (4, near(rng, a, 1))]
    df = spark.createDataFrame([(d, t, "x", 1, 2, "c", "en") for d, t in texts], EXTRA).repartition(3)
    got = Counter((r["doc_id"], r["text"]) for r in jaccard.one_of_each(df).collect())
    assert got == Counter([(3, " ".join(a)), (3, " ".join(b)), (None, "only here"), (None, None), (None, None), (8, ""), (9, "solo text")])
    assert jaccard.one_of_each(df.limit(0)).collect() == []
    unique = df.where("doc_id in (5, 8, 9, 4)")
    assert sorted(r["doc_id"] for r in jaccard.one_of_each(unique).collect()) == [4, 5, 8, 9]


def planned(rows, plan):
    """Words that the mix takes of each (doc_id, source, words)."""
    taken = Counter()
    for r in plan:
        taken[r["doc_id"], r["size"]] += r["taken"]
    return +taken


def test_mix_of_repeated_rows_and_ids(spark):
    rng = np.random.default_rng(8)
    rows = []
    for k in range(300):
        d = None if k % 3 == 0 else int(rng.integers(0, 12))
        words = " ".join(f"w{i}" for i in range(int(rng.integers(0, 4)) * 3))
        rows.append((d, None if k % 50 == 0 else words, f"s{k % 4}" if k % 5 else None, "m", int(k % 7), 1.5))
    for columns in ("doc_id long, text string, source string, mix_key string, mix_size long, last double", "doc_id long, text string, source string, size string, n_chars long, epochs double"):
        df = spark.createDataFrame(rows, columns).repartition(4)
        got, whole = Counter(), 0
        for r in mixing.mixed_documents(df).collect():
            n = len((r["text"] or "").split())
            got[r["source"]] += n
            whole += n % 3 == 0
            if "n_chars" in columns and n % 3:
                assert r["n_chars"] == len(r["text"])
        plan = mixing.mix_plan(df).collect()
        targets = mixing.source_targets(df.select("source", mixing.n_words(F.col("text")).alias("size"))).collect()
        assert {k: v for k, v in got.items() if v} == {r["source"]: int(r["target"]) for r in targets if int(r["target"])}
        assert sum(got.values()) == sum(r["taken"] for r in plan)
        assert len(mixing.mixed_documents(df).columns) == len(df.columns) and whole > 100
        empty = Counter(r["doc_id"] for r in mixing.mixed_documents(df).collect() if not r["text"])
        assert empty == Counter(d for d, t, *_ in rows if not t)


def test_mixed_rows_are_those_of_the_plan(spark):
    rows = [(k, " ".join(f"w{k}.{i}" for i in range(k % 9)), f"s{k % 3}") for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = Counter()
    for r in mixing.mixed_documents(df).collect():
        got[r["doc_id"], len(rows[r["doc_id"]][1].split())] += len(re.findall(r"\S+", r["text"]))
    assert +got == planned(rows, mixing.mix_plan(df).collect())
