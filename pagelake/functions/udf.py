"""Text functions that need sequence matching or running state: Arrow-batched Python."""

from __future__ import annotations

import bisect
import itertools
import re
from collections import Counter, defaultdict, deque
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.functions.blocks import changes
from pagelake.functions.text import MARKERS

_WORD, _SOLID, _DIGIT = re.compile(r"[^\W\d_]+"), re.compile(r"\S+"), 3.5
#: A whole word of four letters or more that doesn't start with a small ASCII letter.
_NOUN = re.compile(r"[^a-z\W\d_](?<![^\W\d_].)[^\W\d_]{3,}")
#: ASCII without letters, as blanks.
_BLANK = {k: " " for k in range(128) if not chr(k).isalpha()}
#: What stands before a sentence's first word.
STARTS = frozenset(("", ".", "!", "?", ":", ";"))
RANGES = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("tag", T.StringType())]))


def _words(text: str) -> list[str]:
    """Runs of letters; in ASCII what blanks leave, which takes a fifth of the time."""
    return text.translate(_BLANK).split() if text.isascii() else _WORD.findall(text)


def _numbered(sides: Iterable[tuple[list[str], list[str]]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words as whole numbers, the same word always by the same one."""
    number = defaultdict(itertools.count().__next__)
    for pair in sides:
        yield tuple(np.fromiter(map(number.__getitem__, words), np.int64, len(words)) for words in pair)


def word_edits(pairs: list[tuple[str, str]]) -> tuple[list[int], list[float]]:
    """For each pair the words of the raw text that a word-level edit script deletes (replaced words don't count), and the letters of the cleaned text by those of the raw one."""
    gone, ratios, at = [0] * len(pairs), [1.0] * len(pairs), []

    def differing() -> Iterator[tuple[list[str], list[str]]]:
        for k, (raw, cleaned) in enumerate(pairs):
            a, b = _words(raw), _words(cleaned)
            if a == b:
                continue
            if a:
                ratios[k] = sum(map(len, b)) / sum(map(len, a))
            if a and b:
                at.append(k)
                yield a, b
            else:
                gone[k] = len(a)

    for n, (i, i_end, j, j_end) in enumerate(changes(_numbered(differing()))):
        gone[at[n]] = int((i_end - i)[j == j_end].sum())
    return gone, ratios


@F.pandas_udf(T.IntegerType())
def words_deleted(raw: pd.Series, cleaned: pd.Series) -> pd.Series:
    return pd.Series(word_edits([(a or "", b or "") for a, b in zip(raw, cleaned, strict=True)])[0], dtype="int32")


def lost_nouns(raw: str, cleaned: str) -> list[str]:
    """Sorted capitalised words of four letters or more, not at a sentence's start, that occur less often in the cleaned text."""
    if raw == cleaned:
        return []
    found = []
    for t in (raw, cleaned):
        at = (m for m in _NOUN.finditer(t) if t[m.start()].isupper())
        found.append(Counter(m[0] for m in at if t[max(0, m.start() - 2) : m.start()].strip() not in STARTS))
    return sorted(found[0] - found[1])


WORD_CHANGES = T.StructType([T.StructField("words_deleted", T.IntegerType()), T.StructField("length_ratio", T.DoubleType()), T.StructField("nouns_dropped", T.ArrayType(T.StringType()))])


@F.pandas_udf(WORD_CHANGES)
def word_changes(raw: pd.Series, cleaned: pd.Series) -> pd.DataFrame:
    pairs = [(a or "", b or "") for a, b in zip(raw, cleaned, strict=True)]
    gone, ratios = word_edits(pairs)
    return pd.DataFrame({"words_deleted": gone, "length_ratio": ratios, "nouns_dropped": [lost_nouns(a, b) for a, b in pairs]})


def _starts(text: str) -> np.ndarray:
    """Where each word starts, and at last the text's end; places count from the first word."""
    edges = np.array([m.start() for m in _SOLID.finditer(text)] + [len(text)])
    return edges - edges[0]


def range_edits(pairs: list[tuple[str, str]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each pair the ranges between the runs of words that both texts have: from and to in either text, one of both may be empty.

    Offsets count from the first word, not from the text's start.
    """
    kept: deque[tuple[np.ndarray, np.ndarray] | None] = deque()
    none = tuple(np.empty(0, np.int64) for _ in range(4))

    def differing() -> Iterator[tuple[list[str], list[str]]]:
        for raw, cleaned in pairs:
            a, b = raw.split(), cleaned.split()
            kept.append(None if a == b else (_starts(raw), _starts(cleaned)))
            if a != b:
                yield a, b

    for i, i_end, j, j_end in changes(_numbered(differing())):
        while (edges := kept.popleft()) is None:
            yield none
        yield edges[0][i], edges[0][i_end], edges[1][j], edges[1][j_end]
    yield from (none for _ in kept)


def changed_ranges(raw: str, cleaned: str) -> dict[str, list[tuple[int, int, str]]]:
    """Ranges of either text that the other lacks, each with what became of it."""
    i, i_end, j, j_end = next(range_edits([(raw, cleaned)]))
    tags = _tags(i, i_end, j, j_end)
    rows = lambda s, e: [(p, q, t) for p, q, t in zip(s.tolist(), e.tolist(), tags) if q > p]
    return {"raw": rows(i, i_end), "cleaned": rows(j, j_end)}


def _tags(i: np.ndarray, i_end: np.ndarray, j: np.ndarray, j_end: np.ndarray) -> list[str]:
    return np.where(i == i_end, "insert_", np.where(j == j_end, "delete_", "replace_")).tolist()


@F.pandas_udf(T.StructType([T.StructField("raw", RANGES), T.StructField("cleaned", RANGES)]))
def diff_ranges(raw: pd.Series, cleaned: pd.Series) -> pd.DataFrame:
    out: dict[str, list[list[dict]]] = {"raw": [], "cleaned": []}
    for i, i_end, j, j_end in range_edits([(a or "", b or "") for a, b in zip(raw, cleaned, strict=True)]):
        tags = _tags(i, i_end, j, j_end)
        for side, s, e in (("raw", i, i_end), ("cleaned", j, j_end)):
            out[side].append([{"start": p, "end": q, "tag": t} for p, q, t in zip(s.tolist(), e.tolist(), tags) if q > p])
    return pd.DataFrame(out)


def marked(text: str) -> list[tuple[int, int, str]]:
    """Every uncertainty marker but the ellipsis, in order of marker, then place."""
    low = text.lower()
    return [(m.start(), m.end(), "marker") for x in MARKERS if x != "..." for m in re.finditer(re.escape(x), low)]


@F.pandas_udf(RANGES)
def marker_ranges(text: pd.Series) -> pd.Series:
    return pd.Series([[{"start": s, "end": e, "tag": t} for s, e, t in marked(x or "")] for x in text])


def _edges(parts: list[str], gap: int) -> list[int]:
    """Where each part begins, and at last the end, if all stand in a row with gaps after them."""
    return [0, *itertools.accumulate(len(p) + gap for p in parts)]


def _by_words(text: str, room: int) -> list[str]:
    """Runs of words, as long as the room allows; a word longer than that is a run by itself."""
    words = text.split()
    edges, cuts = _edges(words, 1), [0]
    while cuts[-1] < len(words):
        cuts.append(max(cuts[-1] + 1, bisect.bisect_right(edges, edges[cuts[-1]] + room + 1) - 1))
    return [" ".join(words[i:j]) for i, j in itertools.pairwise(cuts)]


def _by_parts(parts: list[str], room: int, tail: int, glue: str, inside: bool) -> list[str]:
    """Chunks of consecutive parts. How far a chunk goes is read off the parts' cumulative lengths; it starts with the end
    of the one before, `tail` characters.

    Paragraphs: what is longer than the room, with the tail before it or alone, becomes chunks of its own. Inside such a one
    (inside): a part that doesn't fit a chunk of its own goes by words, and the next parts go on from its last run.
    """
    parts = [p for part in parts if (p := part.strip())]
    edges, out, start, i = _edges(parts, len(glue)), [], "", 0
    while start or i < len(parts):
        if not start:
            start, i = parts[i], i + 1
            if inside and len(start) + len(glue) > room:
                *closed, start = _by_words(start, room)
                out += closed
            elif not inside and len(start) > room:
                out, start = out + _oversize(start, room, tail, glue), ""
                continue
        reach = bisect.bisect_right(edges, edges[i] + room - len(start)) - 1
        if reach > i:  # white space at the start of a tail goes with the first part that follows
            start = start.lstrip()
            reach = bisect.bisect_right(edges, edges[i] + room - len(start)) - 1
            start, i = glue.join([start, *parts[i:reach]]), reach
        if i == len(parts):
            return out + [start.strip()] * bool(start.strip())
        out.append(start)
        start, i = (start[-tail:] + glue if 0 < tail < len(start) else "") + parts[i], i + 1
        if not inside and len(start) > room:
            out, start = out + _oversize(start, room, tail, glue), ""
    return out


def _oversize(text: str, room: int, tail: int, glue: str) -> list[str]:
    """A text longer than the room: by sentences, if there are several, else by words, else as it is."""
    for parts, between in ((re.split(r"(?<=[.!?])\s+", text), glue), (text.split(), " ")):
        if sum(map(bool, map(str.strip, parts))) > 1:
            return _by_parts(parts, room, tail, between, True)
    return [text]


def chunks(text: str, max_tokens: int = 3500, overlap: int = 200, glue: str = "\n\n") -> list[str]:
    """Chunks of a text under an estimated token limit, by paragraph, else sentence, else word; a text that fits is one."""
    if int(len(text) / _DIGIT) <= max_tokens:
        return [text]
    return _by_parts(text.split(glue), int(max_tokens * _DIGIT), int(overlap * _DIGIT), glue, False)


def chunk_rows(df, text: str = "text", max_tokens: int = 3500, overlap: int = 200, dedupe: bool = False, keys: tuple[str, ...] = ("doc_id",)):
    """The keys, chunk_id, chunk: texts that fit pass through in the JVM, only longer ones go to Python.

    The tail that a chunk repeats stays, unless `dedupe` asks for chunks without one.
    """
    long = F.length(text) / F.lit(_DIGIT) >= max_tokens + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = [chunks(t, max_tokens, 0 if dedupe else overlap) for t in b.iloc[:, -1]]
            out = b[list(keys)].assign(chunk_id=[range(len(p)) for p in parts], chunk=parts)
            yield out.explode(["chunk_id", "chunk"]).astype({"chunk_id": "int32"})

    whole = df.where(~long).select(*keys, F.lit(0).alias("chunk_id"), F.col(text).alias("chunk"))
    kinds = [df.schema[k] for k in keys]
    schema = T.StructType([*kinds, T.StructField("chunk_id", T.IntegerType()), T.StructField("chunk", T.StringType())])
    return whole.unionByName(df.where(long).select(*keys, F.col(text).alias("text")).mapInPandas(run, schema))


def reassembled(order: str = "chunk_id", text: str = "chunk", glue: str = "\n\n"):
    """Aggregate: non-blank chunks in order, joined."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text])
    return F.array_join(F.filter(parts, lambda x: F.trim(x) != ""), glue)
