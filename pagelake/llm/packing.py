"""Best-fit packing of token sequences after a Martello-Toth dominance reduction.

Token counts are whole numbers up to the capacity, so an instance of any size is a histogram of `capacity`
numbers. The reduction and the best-fit run on that histogram at the driver, over all pieces; they never see a
row. Their result is a short plan of runs: the a-th to b-th piece of length L go to these sequences at this
offset. Pieces then find their places from their rank among the pieces of their length.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelake.llm.store import arrow_rows, small, stash
from pagelake.llm.text import give_back, kept

CAPACITY = 4096
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, nth long"
#: Rows with whole texts in a batch.
BATCH = 1000
#: Pre-tokens that a worker keeps, and letters-only ones that one call of the tokenizer gets.
CACHE_TOKENS, JOINED = 500_000, 2000
# The classes of the tokenizer's split pattern within Latin-1, after its lower-casing.
LETTERS = rb"a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
NUMBERS = rb"0-9\xb2\xb3\xb9\xbc-\xbe"
SPLIT = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[" + LETTERS + rb"]+|[" + NUMBERS + rb"]|[^ \t-\r" + LETTERS + NUMBERS + rb"]+")
PLAIN = bytes([*range(9, 14), *range(32, 127)])
LOWER = bytes(b if chr(b).lower() == chr(b) else ord(chr(b).lower()) for b in range(256))
#: Runs with other characters, controls, Latin-1 blanks or what may be a control string are left to the tokenizer whole.
ODD = re.compile(r"[^ -~\t-\r\xa1-\xff]|<\|")
OTHER = re.compile(rf"([^ \t-\r]*(?:{ODD.pattern})[^ \t-\r]*)")


class TextIds:
    """Token ids of texts as little-endian 32-bit bytes, equal to the tokenizer's own.

    The tokenizer lower-cases, splits by a pattern that never crosses white space and encodes each part on its
    own, so a text's ids are those of its parts in order. Parts are found here for Latin-1 text and looked up;
    new letters-only ones go to the tokenizer many at a time, joined by blanks, as each of them gives exactly
    one token that ends a word, its last. Everything else is encoded by itself. The cache is emptied when full.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}

    def one(self, run: str) -> bytes:
        return np.array(self.tokenizer.encode(run, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, parts: set[bytes]) -> None:
        words = [w for w in parts if w[-1:].isalpha() and w[:1] != b"'" or w[-1] >= 0xDF]
        groups = [words[k : k + JOINED] for k in range(0, len(words), JOINED)]
        texts = [b" ".join(g).decode("latin-1") for g in groups]
        for group, got in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(got.ids, "<u4")
            stops = 4 * (np.flatnonzero(self.ends[ids]) + 1)
            raw, stops = ids.tobytes(), stops.tolist()
            if len(stops) != len(group):
                self.known.update((w, self.one(w.decode("latin-1"))) for w in group)
            else:
                self.known.update(zip(group, map(raw.__getitem__, map(slice, [0, *stops[:-1]], stops)), strict=True))
        self.known.update((w, self.one(w.decode("latin-1"))) for w in parts.difference(words))

    def of(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each UTF-8 text; the texts' new parts are learnt together, before any is looked up."""
        if len(self.known) > CACHE_TOKENS:
            self.known.clear()
        split = [self._split(t) for t in texts]
        self.learn(set().union(*(x for parts in split for x in parts[::2])).difference(self.known))
        ids = self.known.__getitem__
        return [b"".join(map(ids, parts[0])) if len(parts) == 1 else b"".join(chain.from_iterable(map(ids, x) if k % 2 == 0 else (self.one(x),) for k, x in enumerate(parts))) for parts in split]

    def _split(self, text: bytes) -> list:
        """Parts found here at even places, runs for the tokenizer at odd ones."""
        if text.isascii() and b"<|" not in text and not text.translate(None, PLAIN):
            return [SPLIT.findall(text.lower())]
        whole = text.decode()
        return [SPLIT.findall(x.encode("latin-1").translate(LOWER)) if k % 2 == 0 else x for k, x in enumerate(OTHER.split(whole) if ODD.search(whole) else (whole,))]


def pieces(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces, with task and nth for ranking.

    A document is its ids and then end_id; only one longer than the capacity is cut, every capacity ids. A null
    or empty text is the one id end_id. nth counts pieces of this length in this task. with_ids adds `ids`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids_of, task, seen = kept(f"ids of {tokenizer}", lambda: TextIds(tokenizer)), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        last, step = np.array([end_id], "<u4").tobytes(), 4 * capacity
        for b in batches:
            rows: list[tuple] = []
            for doc, ids in _ids(b, ids_of):
                ids += last
                for k in range(0, len(ids), step):
                    part = ids[k : k + step]
                    n = len(part) // 4
                    rows.append((doc, k // step, k // 4, n, zlib.crc32(part), task, int(seen[n]), part))
                    seen[n] += 1
                    if len(rows) >= 20_000:
                        yield _batch(rows, with_ids)
                        rows = []
            if rows:
                yield _batch(rows, with_ids)
        give_back()

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, PIECE + ", ids binary" * with_ids)


def _ids(b: pa.RecordBatch, ids_of: TextIds, most: int = 4_000_000) -> Iterator[tuple]:
    """doc_id and ids of each row, by groups of rows of about `most` bytes."""
    docs: list = []
    texts: list[bytes] = []
    size = 0
    for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
        docs.append(doc)
        texts.append(text or b"")
        size += len(texts[-1])
        if size > most:
            yield from zip(docs, ids_of.of(texts), strict=True)
            docs, texts, size = [], [], 0
    yield from zip(docs, ids_of.of(texts), strict=True)


def _batch(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    kinds = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int64()), ("nth", pa.int64()), ("ids", pa.binary())]
    kinds = kinds if with_ids else kinds[:-1]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), kinds, strict=False)], names=[n for n, _ in kinds])


class Plan:
    """Runs of equal sequences. Pattern p is `lengths[p]` used `times[p]` times; sequence numbers follow in that order."""

    def __init__(self) -> None:
        self.lengths: list[tuple[int, ...]] = []
        self.times: list[int] = []

    def add(self, lengths: tuple[int, ...], times: int) -> None:
        if times > 0:
            self.lengths.append(lengths)
            self.times.append(times)

    def runs(self) -> dict[int, list[tuple[int, int, int]]]:
        """length -> (first rank, first sequence, offset) in order of rank; each run goes up by one to the next."""
        out: dict[int, list[tuple[int, int, int]]] = {}
        ranks: dict[int, int] = {}
        sequence = 0
        for lengths, times in zip(self.lengths, self.times, strict=True):
            at = 0
            for x in lengths:
                out.setdefault(x, []).append((ranks.get(x, 0), sequence, at))
                ranks[x] = ranks.get(x, 0) + times
                at += x
            sequence += times
        return out

    @property
    def sequences(self) -> int:
        return sum(self.times)


def reduce_instance(counts: dict[int, int], capacity: int, plan: Plan) -> dict[int, int]:
    """Fix the sets that dominate every alternative and return what remains.

    From the longest item x down, with room c = capacity - x: (1) nothing fits: {x}. (2) an item of length c
    fits exactly: {x, c} dominates, as any other company of x could take c's place. (3) y is the longest that
    fits and no two others fit together: {x, y}. (4) of every pair that fits none is longer than y, the longest
    that fits: {x, y} again, as the pair could take y's place.
    """
    left = {x: n for x, n in counts.items() if n > 0}
    order = sorted(left)
    for x in reversed(order):
        while left.get(x, 0):
            room, n = capacity - x, left[x]
            exact = left.get(room, 0)
            if exact and room != x:
                take = min(n, exact)
                plan.add((x, room), take)
                _use(left, x, take), _use(left, room, take)
                continue
            if exact and room == x and n > 1:
                plan.add((x, x), n // 2)
                _use(left, x, n // 2 * 2)
                continue
            fits = [y for y in order[: bisect.bisect_right(order, room)] if left.get(y, 0) - (y == x) > 0]
            if not fits:
                plan.add((x,), n if 2 * x > capacity else 1)
                _use(left, x, n if 2 * x > capacity else 1)
                continue
            y = fits[-1]
            if y != x and 2 * x > capacity and _longest_pair(fits, left, room) <= y:
                take = min(n, left[y])
                plan.add((x, y), take)
                _use(left, x, take), _use(left, y, take)
                continue
            break
    return left


def _use(left: dict[int, int], x: int, n: int) -> None:
    left[x] -= n
    if not left[x]:
        del left[x]


def _longest_pair(fits: list[int], left: dict[int, int], room: int) -> int:
    """The largest sum of two items that fits the room; 0 if none does."""
    best, i, j = 0, 0, len(fits) - 1
    while i <= j:
        total = fits[i] + fits[j]
        if total > room:
            j -= 1
        elif i == j and left[fits[i]] < 2:
            break
        else:
            best = max(best, total)
            i += 1
    return best


def best_fit(counts: dict[int, int], capacity: int, plan: Plan) -> None:
    """Best-fit decreasing on counts: equal items move equal sequences to a smaller room together."""
    rooms: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # room left -> sequences so far
    order: list[int] = []

    def put(room: int, lengths: tuple[int, ...], times: int) -> None:
        if room == 0:
            plan.add(lengths, times)
            return
        if room not in rooms:
            bisect.insort(order, room)
        rooms.setdefault(room, []).append((lengths, times))

    for x in sorted(counts, reverse=True):
        n = counts[x]
        while n:
            k = bisect.bisect_left(order, x)
            if k == len(order):
                each = capacity // x
                put(capacity - each * x, (x,) * each, n // each)
                if n % each:
                    put(capacity - n % each * x, (x,) * (n % each), 1)
                break
            room = order[k]
            lengths, times = rooms[room].pop()
            each = min(room // x, n)
            take = min(times, n // each)
            if not rooms[room]:
                del rooms[room], order[k]
            if times > take:
                put(room, lengths, times - take)
            put(room - each * x, lengths + (x,) * each, take)
            n -= take * each
    for room in order:
        for lengths, times in rooms[room]:
            plan.add(lengths, times)


def plan_of(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    plan = Plan()
    best_fit(reduce_instance(counts, capacity, plan), capacity, plan)
    return plan


def pack(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence_id and offset.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids). Null ids, null and empty
    texts and repeated rows are documents like others; an empty table gives no rows. The texts are tokenised
    once: the pieces' digests are written to the shared folder, so ranks agree whatever runs again.
    """
    with arrow_rows(documents.sparkSession, BATCH):
        p = stash(pieces(documents, tokenizer, capacity, end_id, with_ids), "pieces")
    per_task = p.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    per_task = stash(per_task.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))), "ranks")
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # `capacity` rows at most
    runs = plan_of(counts, capacity).runs()
    table = {x: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for x, r in runs.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("before").to_numpy() + b.column("nth").to_numpy()
            sequence, offset = np.empty_like(rank), np.empty_like(rank)
            for x in np.unique(length):
                at = length == x
                first, start, place_at = table[int(x)]
                k = np.searchsorted(first, rank[at], "right") - 1
                sequence[at], offset[at] = start[k] + rank[at] - first[k], place_at[k]
            cols = [b.column(c) for c in names[:-2]] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, "sequence_id", "offset"]
    ranked = p.join(small(per_task.select("length", "task", "before")), ["length", "task"]).select(*names[:-2], "before", "nth")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)
