"""The training-data operators against brute force, exact round trips, held-out accuracy and awkward tables."""

import hashlib
import json
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from oracle import same
from pyspark.sql import functions as F

from pagelake.llm import chat, features, html, jaccard, language, mixing, packing, quality, queries, rules, text, topk, urls
from pagelake.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls in any column, empty and blank texts, repeated rows, ties, one very long text.
LONG = " ".join(f"word{i % 9973}" for i in range(120_000))
AWKWARD = [
    (1, "a b c d e f g", "en", "s", 13), (1, "a b c d e f g", "en", "s", 13), (2, "A B C D E F G", "en", None, 13), (3, None, None, None, None), (None, "x y", "de", "s", 3),
    (None, None, None, None, None), (4, "", "fr", "t", 0), (5, " \n\t ", "fr", "t", 4), (6, LONG, "en", "t", len(LONG)), (7, "x y", None, "s", 3), (8, "12 34 %%%", "en", "u", 9),
]


@pytest.fixture(scope="module")
def awkward(spark):
    clash = "block string, node string, key string, size string, text_ string, score string, rank string, html string, kept string"
    rows = [r + ("x",) * 9 for r in AWKWARD]
    return spark.createDataFrame(rows, f"{DOCS}, {clash}").repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", ["op2_mix_sources", "op3_chat_format", "op6_exact_top_k", "op8_url_filter"])
def test_query_equals_its_sql(spark, sf_dir, name):
    same(spark, sf_dir, queries.QUERIES[name], queries.ORACLES[name])


# n-gram Jaccard join


def brute_components(rows, percent=80):
    sets = []
    for _, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if (sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j])) or (rows[i][0] is not None and rows[i][0] == rows[j][0] and sets[i] and sets[j]):
                label[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root(i)] = min(d, low.get(root(i), d))
    return Counter((d, len(sets[i]), low.get(root(i))) for i, (d, _) in enumerate(rows))


def near_copies(seed=1):
    rng = np.random.default_rng(seed)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for size in (3, 4, 5, 6, 9, 30, 70, 140, 300):
        base = [f"w{x}" for x in rng.integers(0, 5000, size)]
        for k in range(9):
            words = list(base)
            for _ in range(rng.integers(0, max(1, size // 20) + 1)):
                words[rng.integers(0, len(words))] = f"e{rng.integers(0, 99)}"
            words = words[: len(words) - int(rng.integers(0, 1 + size // 15))] if k % 2 else words
            rows.append((" " if k % 3 else "\n").join(words).upper() if k % 4 == 0 else " ".join(words))
        rows.append(" ".join(base[: size // 2] + passage))
    rows += [" ".join([f"q{x}" for x in rng.integers(0, 999, 20)] + passage) for _ in range(40)]
    return [(int(d), t) for d, t in zip(rng.permutation(len(rows)), rows, strict=True)]


def test_join_equals_brute_force(spark):
    rows = near_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert Counter(map(tuple, jaccard.join(df).collect())) == brute_components(rows)


def test_join_in_tiles_and_trees(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", 8)
    monkeypatch.setattr(jaccard, "PAIRWISE", 3)
    rows = near_copies(2)
    assert Counter(map(tuple, jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == brute_components(rows)


def test_join_of_awkward_rows(awkward, nothing):
    assert Counter(map(tuple, jaccard.join(awkward).collect())) == brute_components([r[:2] for r in AWKWARD])
    assert jaccard.join(nothing).collect() == []


def brute_links(rows, percent=80):
    sets = []
    for _, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset())
    like = lambda x, y: x and y and 100 * len(x & y) >= percent * len(x | y)
    classes = {x: min((d for (d, _), y in zip(rows, sets, strict=True) if x == y and d is not None), default=None) for x in sets if x}
    counts = Counter((d, classes.get(x), sum(bool(like(x, y)) for j, y in enumerate(sets) if j != i)) for i, ((d, _), x) in enumerate(zip(rows, sets, strict=True)))
    names = list(classes)
    return counts, Counter((*sorted((classes[x], classes[y])), len(x & y)) for i, x in enumerate(names) for y in names[:i] if like(x, y))


@pytest.mark.parametrize("tile", [None, 4])
def test_all_links_equal_brute_force(spark, monkeypatch, tile):
    if tile:
        monkeypatch.setattr(jaccard, "TILE_SETS", tile)
    rows = near_copies(3)
    rows += [(1000 + d, t.lower()) for d, t in rows[::3]]  # copies, so classes have sizes
    counts, pairs = brute_links(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = jaccard.links(df).collect()
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == counts
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(rows)
    assert Counter(map(tuple, jaccard.pairs(df).collect())) == pairs and max(n for *_, n in counts) > 2


def test_links_of_awkward_rows(awkward, nothing):
    got = jaccard.links(awkward).collect()
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == brute_links([r[:2] for r in AWKWARD])[0]
    assert jaccard.links(nothing).collect() == jaccard.pairs(nothing).collect() == []


def test_links_equal_their_sql(spark, sf_dir):
    same(spark, sf_dir, queries.QUERIES["op1_jaccard_links"], queries.ORACLES["op1_jaccard_links"])


def test_blocks_meet_and_bounds_hold():
    rng, similar = np.random.default_rng(0), jaccard.Similar()
    for _ in range(400):
        n = int(rng.integers(1, 700))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        gone = int(rng.integers(0, similar.differ(len(a)) + 1))
        b = np.unique(np.concatenate([rng.permutation(a)[gone:], rng.integers(0, 1 << 63, similar.differ(len(a)) - gone, dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= 80 * (len(a) + len(b) - both) and not np.array_equal(a, b):
            assert len(np.intersect1d(jaccard.blocks_of(a, similar), jaccard.blocks_of(b, similar)))
            x, y = jaccard._same_grid(jaccard.point(a, jaccard.grid(len(a))), jaccard.point(b, jaccard.grid(len(b))))
            assert np.minimum(x, y).sum() >= both >= similar.overlap(np.int64(len(a) + len(b)))


def test_folded_points_of_huge_sets_stay_bounds():
    fine = np.full(4096, 2000, np.uint16)  # 8 million shingles
    x, y = jaccard._same_grid(fine, np.empty(64, np.uint16))
    assert len(x) == 64 and x.sum(dtype=np.int64) == 4096 * 2000 and len(y) == 64


def test_tree_finds_what_a_scan_finds():
    rng, similar = np.random.default_rng(3), jaccard.Similar()
    p = rng.poisson(1.5, (300, 64)).astype(np.uint16)
    p[150:] = p[:150]
    p[150:, :3] += 1
    n = p.sum(1).astype(np.int64)
    got = set(zip(*(x.tolist() for x in jaccard.CountTree(p, n).search(p, n, similar)), strict=True))
    assert got == {(i, j) for i in range(300) for j in range(300) if 100 * min(n[i], n[j]) >= 80 * max(n[i], n[j]) and np.minimum(p[i], p[j]).sum() >= similar.overlap(n[i] + n[j])}


def test_folded_hashes_split_like_words():
    for t in (b"", b"  ", b"A b\tC", b"\n x", "Ärger ÄRGER".encode(), b"y" * 5000 + b" z", b"a b " * 700_000):
        words = t.lower().split()
        h = text.folded_hashes(t)
        assert len(h) == len(words) and len(set(h.tolist())) == len(set(words))


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


# mixing


def test_mix_budgets(spark, awkward, nothing, sf_dir):
    p = queries.op2_mix_sources(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source"), "doc_id")
    for r in p.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("target"), F.sum("size").alias("s"), F.max("source_size").alias("ss")).collect():
        assert r["t"] == int(r["target"]) and r["s"] == r["ss"] and r["target"] <= 3 * r["ss"]
    assert p.where("taken > 3 * size").count() == 0
    a = mixing.mix_plan(awkward).collect()
    assert len(a) == len(AWKWARD) and sum(r["taken"] for r in a) <= sum(r["size"] for r in a)
    assert sorted(r["size"] for r in a)[-1] == 120_000
    assert mixing.mix_plan(nothing).collect() == []


def test_mixed_documents_have_the_planned_words(spark):
    rows = [(i, " \n".join(f"w{i}.{k}" for k in range(i % 7)), "en", f"s{i % 4}" if i % 9 else None, 0) for i in range(60)]
    df = spark.createDataFrame(rows, DOCS)
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix_plan(df).collect()}
    got = Counter()
    for r in mixing.mixed_documents(df).collect():
        got[r["doc_id"]] += len((r["text"] or "").split())
        assert rows[r["doc_id"]][1].startswith(r["text"])
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in taken.items() if v}


# chat


def test_every_layout_gives_the_same_turns(spark):
    said = [("user", "q <|im_end|>"), ("assistant", "a \\| <\\|x")]
    layouts = [
        {"prompt": said[0][1], "response": said[1][1], "id": 3}, {"question": said[0][1], "answer": said[1][1]}, {"instruction": said[0][1], "input": "", "output": said[1][1]},
        {"messages": [{"role": r, "content": t} for r, t in said]}, {"conversations": [{"from": {"user": "human", "assistant": "gpt"}[r], "value": t} for r, t in said]}, {"odd": 1}, {"prompt": "p", "messages": []},
    ]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(layouts)] + [(90, "{"), (91, None)], "id long, j string")
    key, turns = chat.json_turns(F.col("j"))
    got = {r["id"]: r["t"] for r in df.select("id", turns.alias("t")).collect()}
    for i in range(5):
        assert [tuple(t) for t in got[i]] == said, layouts[i]
    assert got[5] is got[6] is got[90] is got[91] is None
    table = spark.createDataFrame([(1, said[0][1], said[1][1])], "conv_id long, prompt string, response string")
    assert [(r["role"], r["text"]) for r in chat.table_turns(table).orderBy("turn").collect()] == said
    with pytest.raises(ValueError):
        chat.table_turns(spark.createDataFrame([(1, 2)], "conv_id long, what long"))


def test_chat_round_trip(spark):
    rows = [
        (1, 1, "assistant", "<|im_start|>assistant\n\\<|\\\\|"), (1, 0, "us\ner", "<\\- <|"), (1, 1, "assistant", "<|im_start|>assistant\n\\<|\\\\|"), (2, None, None, None), (2, None, "assistant", ""), (None, 3, "user", "x"), (3, 0, "assistant", LONG),
    ]
    df = spark.createDataFrame([r + ("x", "y") for r in rows], "conv_id long, turn long, role string, text string, seg string, n string")
    f = chat.format_turns(chat.table_turns(df), "conv_id", ["turn"])
    got = {r["conv_id"]: r for r in chat.digests(f, "conv_id").collect()}
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    for c, turns in by.items():
        turns.sort()
        trained = "".join(x for _, _, r, x in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(trained), hashlib.sha256(trained.encode()).hexdigest())
    assert all(r["formatted"].count(chat.START) == len(by[r["conv_id"]]) for r in f.collect())
    assert chat.digests(chat.format_turns(chat.table_turns(df.limit(0)), "conv_id", ["turn"]), "conv_id").collect() == []


# html

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>"</p>"</script></head><body><nav><ul><li><a href=/x>Home</a><li><a>News</a></ul></nav>
<header><div>Site name</div></header><!-- ad <p>hidden</p> --><div class="ad">Buy now</div><div id="page"><div id=cookie-notice>We use cookies here</div>%s</div>
<aside>Related things</aside><div class="comments"><p>First! great article, wrote a reader at length here</p></div><form>Search <input value=x><button>Go</button></form><footer>&copy; us</footer></body></html>"""
ARTICLE = "<h1>Head&shy;line &amp; more</h1><p>A first <b>bold</b>ness, with&nbsp;a <a href=#>link</a>,\n and  a long run of words to be dense.<br>Next line<p>Second &lt;tag&gt; paragraph with its own run of words, more of them.<ul><li>item one of the list<li>item two of it</ul>"


@pytest.mark.parametrize("wrap", ["<article>%s</article>", "<main>%s</main>", "<div class=content>%s</div>", "<div><section>%s</section></div>", "<article><header>%s</header></article>"])
def test_main_text(wrap):
    want = "Head­line & more A first boldness, with a link, and a long run of words to be dense. Next line Second <tag> paragraph with its own run of words, more of them. item one of the list item two of it"
    assert html.main_text(PAGE % (wrap % ARTICLE)) == want


def _paragraphs(n, start=0):
    return "".join(f"<p>Paragraph {i} of the story has this many plain words in it, no more and no fewer.</p>" for i in range(start, start + n))


@pytest.mark.parametrize("article", [
    f"<article><h1>T</h1><p>lead</p><div class=body>{_paragraphs(6)}</div></article>",
    f"<main><h1>T</h1><p>lead</p><div class=body>{_paragraphs(6)}</div></main>",
    f"<div class=post><h1>T</h1><p>lead</p><div class=body>{_paragraphs(6)}</div></div>",
    f"<div class=post><div class=top><h1>T</h1></div><div class=body>{_paragraphs(6)}</div></div>",
    f"<article><section>{_paragraphs(10)}</section><section>{_paragraphs(1, 10)}</section></article>",
    f"<div><section>{_paragraphs(10)}</section><section>{_paragraphs(1, 10)}</section></div>",
    f"<div><section>{_paragraphs(10)}</section>{_paragraphs(1, 10)}</div>",
    f"<div>{_paragraphs(1).replace('<p>', '').replace('</p>', '')}<div>{_paragraphs(10, 1)}</div></div>",
])
def test_main_text_is_not_cut_to_its_largest_part(article):
    want = " ".join(re.sub(r"<[^>]*>", " ", article).split())
    assert html.main_text(PAGE % article) == want
    assert html.main_text(f"<body>{article}<div class=more><a href=/1>One other story</a><a href=/2>Another story</a></div></body>") == want


def test_extract_of_awkward_pages(spark):
    rows = [(1, None, None, "c"), (2, "u", "", "c"), (3, "u", "<p>only</p>", "c"), (3, "u", "<p>only</p>", "c"), (4, "u", "plain text &amp; <b>more", "c"), (5, "u", "<nav>menu</nav>", "c"), (None, "u", "<div>" * 3000 + "deep down text" + "</b>" * 50, "c"), (6, "u", "<p>" + LONG + "<script>", "c"), (7, "u", "<", "c"), (8, "u", "<p title='a>b'>x</p><!-- open", "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in html.extract(df).collect())
    want = [(0, "deep down text"), (1, ""), (2, ""), (3, "only"), (3, "only"), (4, "plain text & more"), (5, ""), (6, LONG), (7, "<"), (8, "x")]
    assert got == [(i, t, len(t)) for i, t in want]
    assert html.extract(df.limit(0)).columns == ["page_id", "url", "text", "n_chars"]


def test_pages_of_the_table_give_their_articles(spark, sf_dir):
    import html as entities

    rows = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in queries.op4_html_text(spark, sf_dir).collect():
        inside = re.search(r"<article>(.*)</article>", rows[r["page_id"]], re.S)[1]
        assert r["text"] == " ".join(entities.unescape(re.sub(r"</?(?:p|h1|br)[^>]*>", " ", re.sub(r"</?b>", "", inside))).split())


# packing


def check_places(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


def test_packing_round_trip(spark, awkward, nothing):
    tokenizer = packing.TextIds(queries.tokenizer_path()).tokenizer
    got = packing.pack(awkward, queries.tokenizer_path(), 64, with_ids=True).collect()
    used = check_places(got, 64)
    assert used <= -(-sum(r["length"] for r in got) // 64) + 1
    parts = {}
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and r["start"] == 64 * r["piece"]
        parts.setdefault((r["doc_id"], r["piece"]), []).append(ids.tolist())
    docs = Counter()
    for d, t, *_ in AWKWARD:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 64):
            docs[d, k // 64, tuple(ids[k : k + 64])] += 1
    assert docs == Counter((d, k, tuple(i)) for (d, k), v in parts.items() for i in v)
    assert packing.pack(nothing, queries.tokenizer_path()).collect() == []


def test_ids_equal_the_tokenizer(monkeypatch):
    ids = packing.TextIds(queries.tokenizer_path())
    monkeypatch.setattr(packing, "CACHE_TOKENS", 10)
    cases = ["don't!'s IT'S ''s o'llx ½a²b x\x85y\xa0z Ærø ΑΣ—b c’d", "<|endoftext|> x", "J̌ é é", "a\x1cb\x00c", "Straße %%% ab.cd 12,3 !!", "", "文字 text", " ".join(f"w{i}x" for i in range(5000))]
    for t, got in zip(cases, ids.of([t.encode() for t in cases]), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == ids.tokenizer.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_every_item_once_and_few_bins(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(rng.lognormal(4, 1.3, 5000).astype(int) + 1, 512).tolist()
    plan = packing.plan_of(Counter(lengths), 512)
    used = Counter()
    for p, times in zip(plan.lengths, plan.times, strict=True):
        assert sum(p) <= 512
        for x in p:
            used[x] += times
    assert used == Counter(lengths) and plan.sequences <= -(-sum(lengths) // 512) + 3


def test_reduction_is_optimal_on_small_instances():
    from itertools import combinations

    def best(items, cap):
        if not items:
            return 0
        first, rest = items[0], items[1:]
        return 1 + min(best([x for i, x in enumerate(rest) if i not in c], cap) for r in range(len(rest) + 1) for c in combinations(range(len(rest)), r) if first + sum(rest[i] for i in c) <= cap)

    rng = np.random.default_rng(5)
    for _ in range(25):
        items = rng.integers(1, 21, 7).tolist()
        plan = packing.Plan()
        left = packing.reduce_instance(Counter(items), 20, plan)
        assert plan.sequences + best(sorted(Counter(left).elements(), reverse=True), 20) == best(sorted(items, reverse=True), 20)


# top-k


def test_top_k_of_awkward_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(np.float32(x)) for x in rng.integers(-2, 3, 4) / 4]) for i in range(300)]
    rows += [(100, rows[100][1]), (301, None), (302, [0.5, None, 0.5, 0.5]), (303, [float("nan")] * 4), (None, [1.0] * 4), (400, [0.5, 0.5]), (401, [1.0, 1.0]), (500, [])]
    df = spark.createDataFrame([r + ("c",) for r in rows], "vec_id long, embedding array<float>, rank string").repartition(3)
    got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 100 == 0, 10).collect()))
    sound = {i: np.floor(1024 * np.array(v)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()}
    want = []
    for q in (i for i in sound if i % 100 == 0):
        scores = sorted((-int(sound[q] @ v), i) for i, v in sound.items() if i != q and len(v) == len(sound[q]))
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores[:10]) if len(sound[q])]
    assert [g for g in got if g[0] != 500] == sorted(want)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 100 == 0).collect() == []


@pytest.mark.parametrize("block", [None, 7])
def test_top_k_of_ids_with_several_vectors(spark, monkeypatch, block):
    if block:  # blocks that cut through an id's vectors
        monkeypatch.setattr(topk, "BLOCK", block)
        monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    rng = np.random.default_rng(4)
    rows = [(i, (rng.integers(-64, 64, 4) / 64).tolist()) for i in range(60)]
    rows += [(7, [1.0, 1.0, 1.0, 1.0 + i / 64]) for i in range(30)] + [(8, [2.0, 1.0, 1.0, i / 64]) for i in range(12)]
    rows += [(0, [0.5, 0.5, 0.5, i / 64]) for i in range(5)] + [(20, [1.0, 0.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 20 == 0, 10).collect()))
    want = []
    for q in (0, 20, 40):
        best = {}
        for i, v in rows:
            for j, w in rows:
                if j == q != i:
                    best[i] = max(best.get(i, -(1 << 60)), int(np.floor(1024 * np.array(v)) @ np.floor(1024 * np.array(w))))
        want += [(q, n + 1, i, s) for n, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:10])]
    assert got == want


# classifiers


def test_quality_held_out(spark, awkward, nothing):
    d = "/root/testdata/sf0.01"
    r = queries.op7_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    right = sum(x["predicted"] == x["quality"] for x in r) / len(r)
    clean = [x["predicted"] for x in r if x["quality"] == 1]
    assert right > 0.93 and sum(clean) / len(clean) > 0.95
    model = quality.fit(awkward, spark.createDataFrame([(1, 1, 0), (6, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int"), F.lit(False))
    scores = quality.score(awkward, model).collect()
    assert len(scores) == len(AWKWARD) and all(0 <= s["score"] <= 1 for s in scores)
    assert quality.score(nothing, model).collect() == [] and quality.fit(nothing, spark.createDataFrame([], "doc_id long, quality int"), F.lit(False)).score(np.zeros((1, len(model.mean)), np.float32))[0] == pytest.approx(0.5)


def test_features_are_the_same_at_every_length():
    cache, part = text.WordHashes(), b"The cat, (and) THE dog. 12% of it!\n"
    once = features.vector(part * 100, cache)
    for times in (7_000, 60_000):  # 56,000 words, and 2 MB, more than one part
        long = features.vector(part * times, cache)
        assert np.allclose(long[: features.WORD_BINS], once[: features.WORD_BINS], atol=1e-6)
        assert long[features.WORD_BINS + features.STRUCTURE.index("stops")] == once[features.WORD_BINS + features.STRUCTURE.index("stops")] and long[features.WORD_BINS + features.STRUCTURE.index("repeat_words")] == pytest.approx(1 - 7 / 8 / times)


def test_quality_reads_n_chars(spark):
    rows = [(i, "the same words in all of them", "en", "s", (10, 100_000)[i % 2] if i % 10 else None) for i in range(400)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i, *_, n in rows if n is not None], "doc_id long, quality int")
    model = quality.fit(docs, labels, F.lit(False))
    scores = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    assert len(scores) == 400 and scores[1] > 0.7 > 0.3 > scores[2] and 0 <= scores[0] <= 1
    assert quality.score(docs.drop("n_chars"), model).count() == 400


def test_factorisation_machine_is_its_formula():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(200, len(quality.STRUCTURE) + quality.WORD_BINS)).astype(np.float32), rng.integers(0, 2, 200).astype(np.float32)
    m = quality.train(x, y)
    c = x[0] - m.mean
    pairs = sum(float(m.factors[i] @ m.factors[j]) * c[i] * c[j] for i in range(40) for j in range(i)) if False else 0.5 * float(((c[:, None] * m.factors).sum(0) ** 2 - ((c[:, None] * m.factors) ** 2).sum(0)).sum())
    assert m.score(x[:1])[0] == pytest.approx(1 / (1 + np.exp(-(m.bias + c @ m.weights + pairs))), rel=1e-3)


def test_language_held_out(spark, awkward, nothing):
    d = "/root/testdata/sf0.01"
    r = queries.op10_language_id(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(x["lang_pred"] == x["lang"] for x in r) / len(r) > 0.98
    decoder = language.fit(awkward, F.lit(False))
    got = [(x["doc_id"], x["lang_pred"]) for x in language.predict(awkward, decoder).collect()]
    assert len(got) == len(AWKWARD) and {p for i, p in got if i in (3, 4, 5, 8)} == {"und"} and {p for i, p in got if i in (1, 6)} <= {"en", "de"}
    assert language.predict(nothing, language.fit(nothing, F.lit(False))).collect() == []


@pytest.mark.parametrize("n", [1, 2, 4, 5, 12])
def test_codewords_are_apart(n):
    c = language.codewords(n)
    gaps = [int((c[i] != c[j]).sum()) for i in range(n) for j in range(i)]
    assert len(c) == n and (not gaps or min(gaps) >= max(1, c.shape[1] // 4))


# URL filters and rules


def test_aliases_share_blocks(spark):
    u = "https://{}/{}".format
    rows = [
        (1, u("a.net", "x"), f'<link rel="canonical" href="{u("example.org", "es/1")}">'), (2, u("b.net", "y?q=1&amp;z"), '<meta http-equiv="refresh" content="0; url=https://a.net/x#top">'), (3, u("c.net", "z"), '<link href="/w" rel=canonical>'),
        (4, u("c.net", "w"), f"<link rel='canonical' href='{u('shop.com', 'de/1')}'>"), (5, u("d.net", "v"), f'<link rel="canonical" href="{u("shop.com", "de/1")}"><meta http-equiv=refresh content="1;url=https://ok.org/a">'),
        (6, u("WWW.Example.ORG", "es/"), None), (6, u("WWW.Example.ORG", "es/"), None), (7, None, "x"), (8, "mailto:x", ""), (9, "https://org", None), (10, u("e.net", "free"), "<link rel=stylesheet href=https://shop.com/de/1>"),
    ]
    df = spark.createDataFrame([r + ("k",) for r in rows], "page_id long, url string, html string, key string")
    got = Counter((r["page_id"], r["rule"], r["verdict"]) for r in urls.judge(df, queries.URL_RULES).collect())
    # 3 and 4 are in one set with 5, as all lead to shop.com/de/1, and that set has an explicit allow
    want = [(1, None, "block"), (2, None, "block"), (3, None, "allow"), (4, None, "allow"), (5, None, "allow"), (6, "example.org/es/", "block"), (6, "example.org/es/", "block"), (7, None, "allow"), (8, None, "allow"), (9, None, "allow"), (10, None, "allow")]
    assert got == Counter(want)
    more = spark.createDataFrame([(u("e.net", "free"), u("b.net", "y?q=1&amp;z")), (None, "x")], "from_url string, to_url string")
    assert {r["page_id"]: r["verdict"] for r in urls.judge(df, queries.URL_RULES, more).collect()}[10] == "block"
    assert urls.judge(df.limit(0), queries.URL_RULES).collect() == []


def test_ledger_measures(awkward, nothing):
    got = {}
    for r in rules.ledger(awkward).collect():
        got.setdefault(r["doc_id"], r)
    assert got[6]["n_words"] == 120_000 and got[6]["word_chars"] == len(LONG) - 119_999 and got[6]["n_repeat_words"] == 120_000
    assert (got[3]["n_words"], got[4]["n_words"], got[5]["n_lines"], got[8]["n_symbols"]) == (0, 0, 0, 3)
    t = "a b c d e\nx\na b c d e\n\n q a b c d".encode()
    n = rules.measure(t, text.WordHashes())
    words = t.split()
    wins = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if wins[tuple(words[i : i + 5])] > 1 for k in range(5)}
    assert n[:6] == (len(words), 16, 0, 1, len(covered), 4)
    assert rules.ledger(nothing).collect() == []


def test_ablation_counts_each_rule(awkward):
    rows = rules.ledger(awkward).collect()
    got = {r["rule"]: r for r in rules.ablation(rules.ledger(awkward), rules.STRICT).collect()}
    for name, bit in rules.BITS.items():
        assert got[name]["failing"] == sum(bool(r["failed"] & bit) for r in rows) and got[name]["only_this"] == sum(r["failed"] == bit for r in rows)
    assert got["all"]["failing"] == sum(r["failed"] > 0 for r in rows)
