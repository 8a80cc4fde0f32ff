"""The pipeline, stage by stage, against plain Python."""

import re
from collections import Counter

import corpus_pipeline as P
from test_llm import brute_components, check_places

from pagelake.llm import mixing, packing, rules
from pagelake.llm.queries import tokenizer_path
from pagelake.llm.text import WordHashes


def test_stages_on_their_own_input(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, rows = docs.columns, {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, d)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows[name] = docs.collect()
        assert name == P.STAGES[-1][0] or docs.columns == columns
    first = [r for r in spark.read.parquet(f"{d}/documents.parquet").collect() if re.search(r"[^\W\d_]", r["text"] or "")]
    assert len(rows["language_id"]) >= 0.98 * len(first)
    kept = []
    for r in rows["language_id"]:
        m = dict(zip(rules.MEASURES, rules.measure((r["text"] or "").encode(), WordHashes()), strict=True))
        if not any(eval(rule, {}, m) for rule in rules.RULES.values()):
            kept.append(r)
    assert sorted(kept) == sorted(rows["quality_rules"])
    groups = brute_components([(r["doc_id"], r["text"]) for r in rows["quality_rules"]])
    assert sorted(r["doc_id"] for r in rows["jaccard_join"]) == sorted(x for x, _, c in groups if x == c)
    plan = mixing.mix_plan(spark.createDataFrame(rows["jaccard_join"], docs.sparkSession.read.parquet(f"{d}/documents.parquet").schema)).collect()
    words = Counter()
    for r in rows["mix_sources"]:
        words[r["doc_id"]] += len(r["text"].split())
    assert +words == +Counter({r["doc_id"]: r["taken"] for r in plan})
    ids = packing.TextIds(tokenizer_path())
    lengths = Counter()
    for r in rows["mix_sources"]:
        lengths[r["doc_id"]] += len(ids.of([r["text"].encode()])[0]) // 4 + 1
    got = Counter()
    for r in rows["best_fit_packing"]:
        got[r["doc_id"]] += r["length"]
    assert got == lengths and check_places(rows["best_fit_packing"], 4096) <= -(-sum(lengths.values()) // 4096) + 1


def test_awkward_documents_pass_through(spark):
    rows = [(1, "the quick brown fox jumps over the lazy dog and runs away", "en", "s", 1), (1, "the quick brown fox jumps over the lazy dog and runs away", "en", "s", 1), (None, None, None, None, None), (2, "", "en", None, 0), (3, "il y a dans la maison une table avec des livres bleus", "fr", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r["doc_id"] for r in P.STAGES[-1][1](spark, docs, "").collect()} <= {1, 3}
    assert P.STAGES[-1][1](spark, docs.limit(0), "").collect() == []


def test_extra_columns_with_clashing_names(spark):
    names = ("score", "ambiguous", "lang_pred", "n_words", "failed", "component_id", "taken", "epochs", "text_", "_text_", "stage_")
    text = "the quick brown fox jumps over the lazy dog and runs away from it"
    rows = [(k, f"{text} w{k % 3}.{i}" if k else None, "en", f"s{k % 2}", *names) for i in range(2) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} string" for n in names))
    columns = docs.columns
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == columns
        found = docs.collect()
        assert found and all(r[n] == n for r in found for n in names)
    assert P.STAGES[-1][1](spark, docs, "").count() == docs.count()
