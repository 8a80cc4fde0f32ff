import difflib
import random
import re

import numpy as np
import pytest

from pagelake.functions import blocks as B
from pagelake.functions import udf as U


def _merged(blocks):
    out = []
    for i, j, n in blocks.tolist():
        if out and (out[-1][0] + out[-1][2], out[-1][1] + out[-1][2]) == (i, j):
            out[-1][2] += n
        else:
            out.append([i, j, n])
    return [tuple(x) for x in out]


def _altered(rnd, a, kinds, share):
    out = []
    for x in a:
        r = rnd.random()
        out += [] if r < share else [rnd.randrange(kinds), x] if r < 2 * share else [*a[rnd.randrange(len(a)) :][:20], x] if r < 2.3 * share else [x]
    return out


@pytest.mark.parametrize(("pairs", "group"), [(B.PAIRS, B.GROUP), (40, 400)])
def test_blocks_are_those_of_difflib(monkeypatch, pairs, group):
    """Repeats, words in common, equal and unrelated texts; also with gaps that hold too many pairs."""
    monkeypatch.setattr(B, "PAIRS", pairs)
    monkeypatch.setattr(B, "GROUP", group)
    monkeypatch.setattr(B, "_plain", None)  # no falling back
    rnd, texts = random.Random(5), []
    for k in range(600):
        kinds, n = rnd.choice([1, 2, 4, 30, 1000]), rnd.choice([0, 1, 5, 30, 200])
        a = [rnd.randrange(kinds) for _ in range(n)] * rnd.choice([1, 1, 1, 3])
        texts.append((a, _altered(rnd, a, kinds, rnd.choice([0, 0.03, 0.3])) if k % 5 else [rnd.randrange(kinds) for _ in range(n)]))
    got = list(B.matching_blocks((np.array(a, np.int64), np.array(b, np.int64)) for a, b in texts))
    assert len(got) == len(texts)
    for (a, b), blocks in zip(texts, got):
        assert _merged(blocks) == [tuple(m) for m in difflib.SequenceMatcher(a=a, b=b, autojunk=False).get_matching_blocks()[:-1]]


def test_a_long_text_of_few_words_is_no_square(monkeypatch):
    """Lines of four words, one word in 2,000 changed: 36 million pairs of equal words, of which no more than PAIRS are held."""
    sizes, runs = [], B._runs
    monkeypatch.setattr(B, "_runs", lambda *a: (sizes.append(len(a[3])), runs(*a))[1])

    def texts(n, every):
        a = "one more line here ".split() * n
        return a, ["other" if k % every == 77 else w for k, w in enumerate(a)]

    a, b = texts(3000, 2000)
    gone = U.word_edits([(" ".join(a), " ".join(b))])[0]
    assert 0 <= gone[0] < 2000 and max(sizes, default=0) <= B.PAIRS
    monkeypatch.setattr(B, "PAIRS", 1000)
    a, b = texts(300, 200)
    gone = sum(j - i for op, i, j, *_ in difflib.SequenceMatcher(a=a, b=b, autojunk=False).get_opcodes() if op == "delete")
    assert U.word_edits([(" ".join(a), " ".join(b))])[0] == [gone]


def test_words_of_ascii_by_blanks():
    text = "".join(map(chr, range(128))) * 2 + "It's 3rd_try"
    assert U._words(text) == U._WORD.findall(text) and U._words(text + "ä") == U._WORD.findall(text + "ä")


def test_ranges_of_many_texts_are_those_of_each():
    """Equal, empty and blank texts between others, in one batch."""
    rnd = random.Random(2)
    some = lambda n: "".join(rnd.choice(["a", "the", "x\x1c", "ä", "d", " \n"]) + rnd.choice([" ", "", "\n"]) for _ in range(n))
    pairs = [(t, rnd.choice([t, some(20), t.replace("a ", " "), "", " " + t, t.replace(" ", "\n")])) for t in map(some, [0, 1, 5, 30] * 100)]
    got = list(U.range_edits(pairs))
    assert len(got) == len(pairs)
    for (a, b), found in zip(pairs, got):
        x, y = ([m.start() for m in re.finditer(r"\S+", t)] + [len(t)] for t in (a, b))
        codes = difflib.SequenceMatcher(a=a.split(), b=b.split(), autojunk=False).get_opcodes()
        want = [(x[i] - x[0], x[i_end] - x[0], y[j] - y[0], y[j_end] - y[0]) for op, i, i_end, j, j_end in codes if op != "equal"]
        assert list(zip(*(f.tolist() for f in found), strict=True)) == want
