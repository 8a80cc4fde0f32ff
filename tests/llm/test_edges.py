"""Operators at their limits: large components, real markup, mixed layouts, deep pages; models against plain formulas."""

import json
import re
import time
import zlib

import numpy as np
import pytest
from oracle import same
from pyspark.sql import functions as F

from pagelake.llm import chat, features, html, language, quality, queries, rules, topk, urls
from pagelake.llm.text import WordHashes


def test_scores_of_large_components_are_exact(spark):
    rng = np.random.default_rng(1)
    for scale in (3e5, 3e7, 3e11):
        rows = [(i, [float(x) for x in np.round(rng.uniform(-scale, scale, 4))]) for i in range(40)]
        rows += [(100 + i, [scale, scale, scale, scale - i]) for i in range(6)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 100 == 0, 5).collect()))
        whole = {i: [int(np.floor(1024 * x)) for x in v] for i, v in rows}
        clip = lambda x: max(-(2**63) + 1, min(2**63 - 1, x))
        want = []
        for q in (0, 100):
            s = sorted((-clip(sum(a * b for a, b in zip(whole[q], v))), i) for i, v in whole.items() if i != q)
            want += [(q, n + 1, i, -x) for n, (x, i) in enumerate(s[:5])]
        assert got == sorted(want)
    huge = spark.createDataFrame([(0, [1e16, -1e300]), (1, [1e16, 2.0])], "vec_id long, embedding array<double>")
    assert topk.top_k(huge, F.col("vec_id") == 0).count() == 1


def test_links_of_real_markup_only(spark):
    ok = "http://x.org/a/b.html"
    pages = {
        1: '<link href="y" rel=canonical>', 2: "<LINK REL='alternate  Canonical' HREF='../c?d=1&amp;e=2#f'>", 3: '<!-- <link rel=canonical href="/no"> -->', 4: '<script><link rel=canonical href="/no"></script>',
        5: '<base href="http://z.org/q/"><link rel="canonical" href="./r/../s">', 6: '<meta content="0; URL=\'//W.com\'" http-equiv=Refresh>', 7: '<link rel=non-canonical href="/no">', 8: '<link rel="canonical" href="b.html">', 9: None,
        10: '<link title="a>b" rel="canonical" href="?k&#61;v">', 11: '<link rel=canonical href="/../../up">', 12: '<link rel=canonical href="mailto:a@b">',
    }
    df = spark.createDataFrame([(i, ok, h) for i, h in pages.items()], "page_id long, url string, html string")
    got = {i: [r["b"] for r in urls.page_links(df.where(F.col("page_id") == i)).where("a <> '' and b <> '' and a <> b").collect()] for i in pages}
    want = {1: ["x.org/a/y"], 2: ["x.org/c?d=1&e=2"], 5: ["z.org/q/s"], 6: ["w.com/"], 10: ["x.org/a/b.html?k=v"], 11: ["x.org/up"]}
    assert got == {i: want.get(i, []) for i in pages}


def test_relative_links_carry_decisions(spark):
    rules_ = (urls.Rule("block", "x.org", "/bad/"), urls.Rule("allow", "x.org", "/good/"))
    rows = [(1, "http://x.org/p/1", '<link rel=canonical href="../bad/1">'), (2, "http://x.org/p/2", "<p>"), (3, "http://y.org", '<link rel=canonical href="http://x.org/p/1">'), (4, "http://y.org/", ""), (5, "http://x.org/p/5", '<link rel=canonical href="/bad/5"><link rel=canonical href="/good/5">'), (None, None, None)]
    df = spark.createDataFrame([r + ("c",) for r in rows], "page_id long, url string, html string, key string")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(df, rules_).collect()}
    assert got == {1: "block", 2: "allow", 3: "block", 4: "block", 5: "allow", None: "allow"}


@pytest.mark.parametrize("name", ["op3_mixed_layouts", "op8_url_aliases"])
def test_further_queries_equal_their_sql(spark, sf_dir, name):
    same(spark, sf_dir, queries.QUERIES[name], queries.ORACLES[name])


def test_further_fields_never_hide_a_layout(spark):
    table = spark.createDataFrame([(1, 0, "user", "hi", "q", "x", "m")], "conv_id long, turn long, role string, text string, question string, input string, prompt string")
    assert [tuple(r) for r in chat.table_turns(table).collect()] == [(1, 0, "user", "hi")]
    said = [("user", "p"), ("assistant", "r")]
    records = [{"prompt": "p", "response": "r", "text": "t"}, {"prompt": "p", "response": "r", "conv_id": 3, "role": "x"}, {"messages": [{"role": "user", "content": "p", "id": 1}, {"role": "gpt", "content": "r"}], "prompt": "p"}, {"messages": []}, {"data": {"prompt": "p", "response": "r"}}]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(records)], "id long, j string")
    got = {r["id"]: r["t"] for r in df.select("id", chat.json_turns(F.col("j"))[1].alias("t")).collect()}
    assert [got[i] and [tuple(t) for t in got[i]] for i in range(5)] == [said, said, said, None, None]


def test_deep_and_broken_pages_take_linear_time():
    def took(n):
        page = "<div>" * n + "text in the depths of it" + "</span>" * n
        t = time.process_time()
        assert html.main_text(page) == "text in the depths of it"
        return time.process_time() - t

    took(500)
    assert took(20_000) < 40 * max(took(2_000), 0.01)


def test_density_by_its_formula():
    page = "<body><div><p>one two three four five</p><p>a <a href=x>link here</a> more</p></div><ul><li><a>x</a></ul></body>"
    root = html.parse(page)
    body = root.kids[0]
    order = html._weigh(body)
    html._densities(order, body)
    ratio = body.link_chars / body.chars
    for n in order:
        if n.name not in html.BLOCK or not n.chars:
            assert n.density == 0
            continue
        text = n.chars
        spread = max(text / max(n.link_chars, 1) * max(n.tags, 1) / max(n.link_tags, 1), 1)
        base = text / max(text - n.link_chars, 1) * n.link_chars + ratio * text + np.e
        assert n.density == pytest.approx(text / max(n.tags, 1) * np.log(spread + np.e - 1) / max(np.log(base), 1))
        assert n.sum == pytest.approx(sum(k.density for k in n.kids if not isinstance(k, str) and k.name in html.BLOCK) + sum(k.sum for k in n.kids if not isinstance(k, str) and k.name not in html.BLOCK))


def test_factorisation_machine_sums_all_pairs():
    rng = np.random.default_rng(2)
    d = 12
    m = quality.FactorisationMachine(0.3, rng.normal(size=d), rng.normal(size=(d, 3)), rng.normal(size=d))
    for x in rng.normal(size=(5, d)):
        c = x - m.mean
        z = m.bias + c @ m.weights + sum((m.factors[i] @ m.factors[j]) * c[i] * c[j] for i in range(d) for j in range(i))
        assert m.score(x[None])[0] == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def test_feature_vectors_by_plain_counting():
    import xxhash

    for t in ("The cat, the dog!\nThe cat, the dog!\nUp 12% | x.", "a", "Ünïcode wörds\n\n\nhere; a:b"):
        raw = t.encode()
        words = [w.lower().strip(b".,!?;:#*$%&|") for w in raw.split()]
        bins = np.zeros(features.WORD_BINS)
        for w in words:
            bins[(xxhash.xxh3_64_intdigest(w) >> 40) % features.WORD_BINS] += 1
        got = features.vector(raw, WordHashes(), 7)
        assert np.allclose(got[: features.WORD_BINS], bins / np.linalg.norm(bins))
        stats = dict(zip(features.STRUCTURE, got[features.WORD_BINS :], strict=True))
        chars = len(raw) - raw.count(b" ") - raw.count(b"\n")
        lines = [x for x in raw.split(b"\n") if x.strip()]
        assert stats["upper"] == pytest.approx(len(re.findall(rb"[A-Z]", raw)) / chars) and stats["digits"] == pytest.approx(len(re.findall(rb"[0-9]", raw)) / chars)
        assert stats["repeat_words"] == pytest.approx(1 - len(set(words)) / len(words)) and stats["repeat_lines"] == pytest.approx(1 - len(set(lines)) / len(lines))
        assert stats["n_chars"] == pytest.approx(np.log1p(7) / 14) and stats["no_n_chars"] == 0


def test_words_of_very_long_texts_count_like_those_of_short_ones():
    part = "The House, of the Rising Sun! and 12 others; "
    short, long = (features.vector((part * n).encode(), WordHashes()) for n in (100, 60_000))
    assert np.allclose(short[: features.WORD_BINS], long[: features.WORD_BINS])


def test_ngrams_by_plain_counting(monkeypatch):
    for stride in (1 << 20, 7):
        monkeypatch.setattr(language, "STRIDE", stride)
        for t in ("Hello, World 12!", "é", "ab", "Die Straße ist lang"):
            folded = b" " + b" ".join(t.encode().translate(language.FOLD).split()) + b" "
            counts = np.zeros(language.NGRAM_BINS)
            for n in range(1, 5):
                for i in range(len(folded) - n + 1):
                    h = 0
                    for j in range(n):
                        h = (h * 0x01000193 + folded[i + j] + j + 1) & 0xFFFFFFFF
                    counts[(h * 0x9E3779B1 & 0xFFFFFFFF) >> 20] += 1
            assert np.allclose(language.ngrams(t.encode()), np.sqrt(counts / counts.sum()), atol=1e-6)


def test_the_decoder_takes_the_codeword_of_least_loss():
    rng = np.random.default_rng(4)
    for n in (2, 4, 9):
        code = language.codewords(n)
        bits = code.shape[1]
        assert len({tuple(c) for c in code}) == n
        d = language.Decoder(tuple(map(str, range(n))), code, rng.normal(size=(6, bits)), rng.normal(size=bits), rng.uniform(0.5, 2, bits))
        for x in rng.normal(size=(20, 6)):
            loss = [sum(d.trust[b] * np.log1p(np.exp(-(x @ d.weights[:, b] + d.bias[b]) * c[b])) for b in range(bits)) for c in code]
            best, share = d.predict(x[None])
            assert best[0] == int(np.argmin(loss)) and share[0] == pytest.approx(np.exp(-min(loss)) / sum(np.exp(-x) for x in loss))


def test_training_memory_does_not_grow_with_languages(spark, monkeypatch):
    monkeypatch.setattr(language, "TOTAL", 40)
    docs = spark.createDataFrame([(i, f"text {i % 25} of its own", f"l{i % 25:02}") for i in range(5000)], "doc_id long, text string, lang string")
    seen = []
    monkeypatch.setattr(language, "train", lambda x, y, names: seen.append((len(y), len(names))))
    language.fit(docs, F.lit(False))
    assert 10 <= seen[0][0] <= 90


def test_added_columns_take_a_prefix(spark):
    df = spark.createDataFrame([(1, "some words of a text", "x", "y", 2)], "doc_id long, text string, failed string, score string, n_words long")
    keep = tuple(df.columns)
    decoder = language.Decoder((), np.zeros((0, 1), np.int8), np.zeros((language.NGRAM_BINS, 1)), np.zeros(1), np.ones(1))
    for f in (lambda **k: rules.ledger(df, keep, **k), lambda **k: language.predict(df, decoder, keep, **k)):
        with pytest.raises(ValueError):
            f()
        assert f(prefix="own_").select(*keep).collect() == df.collect()
    assert rules.ledger(df, keep, "own_").where(rules.passes(rules.BASE, "own_")).count() == 0


def test_crc_of_ids_is_that_of_their_text(spark):
    df = spark.createDataFrame([(i,) for i in (0, 7, -3, 10**12, None)], "doc_id long")
    got = {r[0]: r[1] for r in df.select("doc_id", quality.crc32_of_id(F.col("doc_id"))).collect()}
    assert got == {i: zlib.crc32(b"" if i is None else str(i).encode()) for i in got}


def test_density_finds_articles_without_word_lists(spark, monkeypatch):
    import html as entities

    monkeypatch.setattr(html, "_furniture", lambda n: n.name in ("script", "style", "noscript", "template", "head", "title"))
    monkeypatch.setattr(html, "_outermost", lambda *a: None)
    rows = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    inside = [re.search(r"<article>(.*)</article>", h, re.S)[1] for h in rows]
    want = [" ".join(entities.unescape(re.sub(r"</?(?:p|h1|br)[^>]*>", " ", re.sub(r"</?b>", "", x))).split()) for x in inside]
    assert sum(html.main_text(h) == w for h, w in zip(rows, want, strict=True)) >= 0.95 * len(rows)


def test_texts_that_no_mapping_takes_are_named(spark):
    rows = {
        1: '{"instruction":"do","input":"this","output":"done","system":"be kind"}', 2: '{"data":{"prompt":"a","response":"b"}}', 3: '{"prompt":"a","response":"b","note":"c","n":3,"empty":" "}',
        4: '{"messages":[{"role":"user","content":"a","tool":"t"}],"tags":["x",1]}', 5: "no json", 6: "[1]", 7: "{}", 8: None,
    }
    df = spark.createDataFrame(list(rows.items()), "id int, j string")
    got = {r["id"]: r["u"] for r in df.select("id", chat.json_unused(F.col("j")).alias("u")).collect()}
    assert got == {1: [], 2: ["data.prompt", "data.response"], 3: ["note"], 4: ["messages[].tool", "tags[]"], 5: None, 6: None, 7: [], 8: None}
    turns = df.where("id = 1").select(chat.json_turns(F.col("j"))[1].alias("t")).first()["t"]
    assert [(t["role"], t["text"]) for t in turns] == [("system", "be kind"), ("user", "do\n\nthis"), ("assistant", "done")]


def test_tags_inside_attribute_values_are_none(spark):
    pages = spark.createDataFrame(
        [
            (1, "http://a.net/1", "<p title='<link rel=canonical href=http://example.org/es/2>'>x</p>"), (2, "http://a.net/2", '<p title="it\'s > all"><link rel=canonical href="http://example.org/es/2">'),
            (3, None, "<link rel=canonical href=http://example.org/es/2>"), (4, "none", "x"), (5, "http://a.net/5", "<a b='>'><LINK REL='canonical' HREF='http://example.org/es/2'>"),
        ],
        "page_id long, url string, html string",
    )
    got = {r["page_id"]: r["verdict"] for r in urls.judge(pages, queries.URL_RULES).collect()}
    assert got == {1: "allow", 2: "block", 3: "allow", 4: "allow", 5: "block"}


PARAGRAPH = "The quick brown fox jumps over the lazy dog and runs far away into the deep green woods where nobody goes. " * 4


@pytest.mark.parametrize("word", "social search share related notice ad menu reply comments sidebar banner promo alert dialog modal popup toolbar sharing sponsored subscription".split())
def test_class_words_do_not_delete_an_article(word):
    text = html.main_text(f'<body><p>A short lead.</p><div class="content {word}-history"><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p></div></body>')
    assert text.count("quick brown fox") == 8
    assert html.main_text(f'<body><div class="{word}">Buy this now and be happy.</div></body>') == ""


def test_lists_of_references_stay_in_their_article():
    links = "<ul>" + "".join(f'<li><a href="x{i}">Reference number {i}</a></li>' for i in range(4)) + "</ul>"
    between = html.main_text(f"<body><article><p>{PARAGRAPH}</p>{links}<p>{PARAGRAPH}</p></article></body>")
    after = html.main_text(f"<body><article><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p>{links}</article></body>")
    assert "Reference number 3" in between and "Reference" not in after


def test_extract_takes_any_column_names(spark):
    pages = spark.createDataFrame([(1, "<p>Some words of text.</p>", "x", "y")], "page_id long, html string, _html_ string, text string")
    r = html.extract(pages).first()
    assert (r["_html_"], r["text"], r["n_chars"]) == ("x", "Some words of text.", 19)
