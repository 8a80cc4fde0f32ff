"""Turn repair, importance resampling and language-model scores against brute force, their SQL and awkward tables."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from oracle import same
from pyspark.sql import functions as F

from pagelake.llm import lm, queries, resample, turns
from pagelake.llm.store import WIDE_ROWS, stash, wide_rows

LONG = " ".join(f"word{i % 9973}" for i in range(300_000))
TEXTS = [
    (1, "The cat sat. The cat ran!"), (1, "The cat sat. The cat ran!"), (2, None), (3, ""), (4, " \n\t "), (5, LONG), (None, "x y z"), (None, None), (6, "Ünïcode ÄB 12-34_x " * 12), (7, "the cat sat on the mat " * 9),
    (8, "<<>> --"), (9, "The\x0bend \x00 of"),
]
CLASH = "n_features string, weight string, score string, at string, n string, piece string, lm_piece string, kind string, words string"


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([r + ("x",) * 9 for r in TEXTS], f"doc_id long, text string, {CLASH}").repartition(3)


@pytest.mark.parametrize("name", ["op11_turn_repair", "op12_importance_resampling"])
def test_query_equals_its_sql(spark, name):
    same(spark, "/root/testdata/sf0.001", queries.QUERIES[name], queries.ORACLES[name])


# turn repair


def search(initials, faults):
    """The cheapest repair by Dijkstra's search over edits, audits as ties."""
    after = {("^", "s"): "s", ("^", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    heap, done = [(0, "", 0, "^")], set()
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if i == len(initials) and state in "^a":
            return cost, audit
        if (i, state) in done:
            continue
        done.add((i, state))
        moves = [(2, "I", i, r) for r in "ua"]
        if i < len(initials):
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state))
            if faults[i] not in ("blank", "duplicate"):
                extra = faults[i] == "truncated"
                moves += [(extra, "K", i + 1, initials[i]), (2 + extra, "R", i + 1, "u"), (2 + extra, "R", i + 1, "a")]
        for price, letter, k, role in moves:
            if (state, role) in after:
                heapq.heappush(heap, (cost + price, audit + letter, k, role))
    raise AssertionError


def test_cheapest_equals_a_search():
    rng = random.Random(5)
    for _ in range(4000):
        n = rng.randint(0, 9)
        initials, faults = [rng.choice("suaax") for _ in range(n)], [rng.choice(["", "", "", "blank", "duplicate", "truncated"]) for _ in range(n)]
        assert turns.cheapest(initials, faults) == search(initials, faults)


def test_long_conversation_takes_linear_time():
    n = 60_000
    cost, audit = turns.cheapest(["u"] * n, [""] * n)
    assert (cost, len(audit.replace("I", ""))) == (2 * (n // 2), n)


def report(rows):
    """One conversation by plain Python: rows of turn, role, text."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults = set(), []
    for _, role, text in rows:
        said = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not said else "duplicate" if (role, text) in seen else "" if said[-1] in ".!?" else "truncated")
        seen.add((role, text))
    initials = [r[:1] for _, r, _ in rows]
    cost, audit = search(initials, faults)
    numbers, out, left = {t for t, *_ in rows if t is not None}, [], iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(left)[1:]
        if edit != "D":
            other = "assistant" if out and out[-1].startswith("u") else "user"
            out.append(f"{role if edit == 'K' else other}:{text}")
    illegal = sum(a + b not in ("su", "ua", "au") or not a or not b for a, b in zip(initials, initials[1:], strict=False))
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


@pytest.mark.parametrize("held", [turns.HELD, 40, 0])
def test_repair_equals_plain_python(spark, held):
    rng = random.Random(3)
    words = ["Yes.", "No", "", " \n", "What?", "Ünï!  ", "Yes.", "long " * 30, None]
    rows = [(c if c else None, rng.choice([None, 0, 1, 2, 3, 5, 9]), rng.choice(["user", "assistant", "system", "", "tool", None]), rng.choice(words), "x", "y") for c in range(40) for _ in range(rng.randint(1, 12))]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, audit string, present string").repartition(5)
    groups = defaultdict(list)
    for c, t, r, x, *_ in rows:
        groups[c].append((t, r, x))
    got = {r[0]: tuple(r)[1:] for r in turns.repair(table, held=held).collect()}
    assert got == {c: report(g) for c, g in groups.items()}


def test_conversations_without_turns(spark):
    table = spark.createDataFrame([(1, 0, "user", "Hi.", False), (1, 1, "user", "Hi.", None), (2, 0, "user", "Hi.", True)], "conv_id int, turn int, role string, text string, present boolean")
    got = {r["conv_id"]: r for r in turns.repair(table, F.col("present")).collect()}
    assert tuple(got[1])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) and got[2]["audit"] == "KI"
    assert turns.repair(table.limit(0)).count() == 0


# importance resampling


def plain_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [zlib.crc32(x.encode()) % 10000 for x in words + [" ".join(p) for p in zip(words, words[1:], strict=False)]]


def plain_resample(rows, target, percent=25, least=20):
    docs, aim = [(i, *plain_features(t)) for i, t in rows], Counter(b for t in target for b in plain_features(t)[1])
    have = Counter(b for *_, f in docs for b in f)
    s, t = have.total(), aim.total()
    gain = {b: math.floor(1000 * math.log((aim[b] + 1) * (s + 10000) / ((have[b] + 1) * (t + 10000)))) for b in have}
    out = []
    for i, words, f in docs:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words) >= least])
    ranked = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(ranked[: percent * len(ranked) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in out), key=repr)


@pytest.mark.parametrize("least, percent", [(1, 100), (3, 55), (20, 25)])
def test_resample_equals_plain_python(spark, texts, least, percent):
    target = spark.createDataFrame([("the cat",), (None,), ("word1 word2 Ünïcode",)], "text string")
    got = resample.resample(texts, target, percent=percent, least_words=least)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_resample([(i, t) for i, t in TEXTS], ["the cat", None, "word1 word2 Ünïcode"], percent, least)


def test_resample_without_rows(spark, texts):
    none = texts.limit(0)
    assert resample.resample(none, none).count() == 0
    assert resample.resample(texts, none).count() == len(TEXTS)


def test_repeated_rows_take_ranks_in_turn(spark):
    table = spark.createDataFrame([(1, "a b c")] * 50 + [(2, "a b d")] * 50, "doc_id long, text string").repartition(7)
    ranks = sorted(r["rank"] for r in resample.resample(table, table, percent=60, least_words=1).collect() if r["rank"])
    assert ranks == list(range(1, 61))


# language-model scores


def plain_tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def plain_scores(rows, training):
    count, both = Counter(), Counter()
    for text in training:
        found = plain_tokens(text)
        count.update(found), both.update(zip([None, *found], found, strict=False))
    total, different = count.total(), len(count)
    seen_n = Counter(both.values())
    discount = min(0.95, max(0.1, seen_n[1] / (seen_n[1] + 2 * seen_n[2])))
    followers = Counter(v for v, _ in both)
    middle = {c: lm.MIDDLE[int(lm.levels(np.array([c]))[0])] for c in set(both.values())}
    out = []
    for text in rows:
        found, base, own = plain_tokens(text), 0.0, 0.0
        for v, w in zip([None, *found], found, strict=False):  # None is an end, also the one before a text
            alone = (count[w] + 0.5) / (total + 0.5 * (different + 1))
            base += math.log10(alone)
            pair = both[v, w]
            seen = min(middle[pair], count[v], count[w]) if pair else 0
            own += math.log10((max(seen - discount, 0) + discount * followers[v] * alone) / count[v] if count[v] else alone)
        out.append((len(found), sum(count[w] > 0 for w in found), total, base, own))
    return out


@pytest.mark.parametrize("limit", [lm.FILTER_BYTES, 0])
def test_scores_equal_plain_counting(spark, texts, limit, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_CHARS", 100_000)  # many shards
    monkeypatch.setattr(lm, "TEXT", 5000)
    held = F.coalesce(F.col("doc_id"), F.lit(0)) == 7
    model = lm.fit(texts, held)
    assert model.n_shards > 10
    got = lm.score(texts, model, keep=("doc_id", "n_features", "text"), limit=limit).collect()
    expected = plain_scores([t for _, t in TEXTS], [t for i, t in TEXTS if i != 7])
    mine = sorted((repr((r["doc_id"], r["text"])), r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got)
    for a, b in zip(mine, sorted((repr(k), *e) for k, e in zip(TEXTS, expected, strict=True)), strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-9)
        assert a[5] == pytest.approx(b[5], rel=0.02, abs=0.5)  # a pair that was never seen is found now and then


def test_both_ways_agree_on_documents(spark, sf_dir):
    docs = queries.read(spark, sf_dir, "documents")
    held = queries.remainder(5) == 1
    model = lm.fit(docs, held)
    one, other = ({(r["doc_id"], r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in lm.score(docs, model, limit=n).collect()} for n in (lm.FILTER_BYTES, 0))
    assert one == other and len(one) == docs.count()
    scored = lm.score(docs, model).where(held).agg(F.sum("base_score"), F.sum("score"), F.min(F.col("score"))).first()
    assert scored[0] < scored[1] < 0  # texts of both folds are alike


def test_filter_keeps_every_level():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 63, 50_000, dtype=np.uint64) * np.uint64(2)
    counts = rng.zipf(1.6, len(keys)).clip(1, 1 << 40)
    raw = lm.bloom(keys, counts)
    found = lm.read_levels(raw, keys)
    assert (found >= lm.levels(counts)).all() and (found > lm.levels(counts)).mean() < 0.02
    assert (lm.read_levels(raw, keys + np.uint64(1)) > 0).mean() < 0.01
    assert np.abs(lm.MIDDLE[lm.levels(counts)] / counts - 1).max() < 0.35
    few = np.arange(1, 200)
    assert [set(few[lm.levels(few) == k]) >= {math.floor(lm.MIDDLE[k])} for k in range(1, 13)] == [True] * 12


def test_scores_without_training(spark, texts):
    none = texts.limit(0)
    model = lm.fit(none, F.lit(False))
    assert lm.score(none, model).count() == 0
    for limit in (lm.FILTER_BYTES, 0):
        got = lm.score(texts.where("doc_id = 1"), model, limit=limit).collect()
        assert {(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got} == {(7, 0, 0, 0.0, 0.0)}


def test_rows_of_several_megabytes_go_through_a_few_at_a_time(spark):
    """A row group or a batch with a hundred of a model's pieces takes more than an executor has."""
    import pyarrow.parquet as pq

    noise = lambda batches: (pa.RecordBatch.from_arrays([pa.array([np.random.default_rng(k).bytes(4_000_000)])], names=["data"]) for b in batches for k in b.column(0).to_pylist())
    made = stash(spark.range(0, 30, 1, 1).mapInArrow(noise, "data binary"), "wide", **WIDE_ROWS)
    groups = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in made.inputFiles()]
    assert sum(m.num_rows for m in groups) == 30 and max(m.row_group(k).num_rows for m in groups for k in range(m.num_row_groups)) <= 12
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in batches)
    with wide_rows(spark):
        assert max(r["n"] for r in made.mapInArrow(sizes, "n long").collect()) <= 6 * 4_000_000


def test_scores_by_shuffle_keep_columns_of_any_name(spark):
    texts = spark.createDataFrame([(k, f"w{k % 3} a b c", 2 * k, k + 1) for k in range(40)], "doc_id long, text string, kind int, piece long")
    model = lm.fit(texts, F.lit(False))
    one, other = (sorted(lm.score(texts, model, keep=("doc_id", "kind", "piece"), limit=n).collect()) for n in (lm.FILTER_BYTES, 0))
    assert one == other and len(one) == 40
