"""Language-model scores from a log-frequency Bloom filter.

Training texts give exact counts of tokens and, as quantised counts, of pairs of tokens: a pair seen c times is entered
at levels 1 to 1 + log c of a Bloom filter, so its count is read back by asking for one level after the other until one
is missing. The filter comes in shards by hash, each as large as its entries ask for. All shards are broadcast while
they are within FILTER_BYTES; beyond that, texts send what they have to ask to the shards, by shuffle, and get the
counts back: the same scores either way.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.llm.store import WIDE_ROWS, arrow_rows, discard, schema_of, stash, unused, wide_rows, with_text
from pagelake.llm.text import folded_texts, give_back, mix

#: A pair's level is 1 + floor(log c / log BASE); each level is PROBES bits, half of them in each of two words. 1 / ln 2 bits of filter go to each bit set, so half are.
BASE, PROBES = 1.5, 8
#: Bounds of what each pair's count is lowered by; what that frees goes to the token's own probability.
DISCOUNTS = (0.1, 0.95)
#: Filter and token counts that are broadcast at most; text that one shard gets, on average; bytes of text counted, or scored, at once.
FILTER_BYTES, SHARD_CHARS, TEXT = 1 << 28, 1 << 23, 1 << 21
#: Bytes of one broadcast, about.
SENT = 1 << 24
END = np.uint64(0xC3A5C85C97CB3127)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LOW, _HALF = np.uint64(0xFFFFFFFF), np.uint64(32)
#: Kinds of rows: counts of words, the filter of pairs, and, on the way, how many different tokens follow each.
WORDS, PAIRS, FOLLOWERS = 0, 1, 2


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word, A-Z lower-cased, and an end after each text, end to end; and the number of tokens of each text."""
    found, lengths = folded_texts(texts)
    return np.insert(found, np.cumsum(lengths), END), lengths + 1


def pairs(found: np.ndarray) -> np.ndarray:
    """A key of each token with the one before it: half a hash of both, half the upper one of the former. Before the first token of a text there is an end."""
    before = np.concatenate([[END], found[:-1]])
    return (mix(before * _STEP + found) & ~_LOW) | (before >> _HALF)


def levels(count: np.ndarray) -> np.ndarray:
    """1 for a count of 1, and one more for each factor of BASE."""
    return (1 + np.floor(np.log(count) / math.log(BASE) + 1e-9)).astype(np.int64)


#: The middle of the whole counts that have a level; level 0 is no count.
_LOWEST = np.ceil(BASE ** np.arange(120) - 1e-9)
MIDDLE = np.concatenate([[0.0], (_LOWEST[:-1] + _LOWEST[1:] - 1) / 2])


#: Half of a level's bits, as set in one word of the filter.
_MASKS = np.bitwise_or.reduce(np.uint64(1) << np.random.default_rng(8).random((4096, 64)).argsort(1)[:, : PROBES // 2].astype(np.uint64), axis=1)


def _places(keys: np.ndarray, level: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The two words, of `size`, where a key's level has bits, and these bits."""
    h = keys + np.full(1, level, np.uint64) * _STEP
    for _ in range(2):
        h = mix(h)
        yield ((h >> _HALF) * np.uint64(size)) >> _HALF, _MASKS[h & np.uint64(4095)]


def bloom(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The filter of different keys and their counts, in 64-bit words."""
    level = levels(counts)
    filter_ = np.zeros(max(1, math.ceil(int(level.sum()) * PROBES / math.log(2) / 64)), np.uint64)
    for now in range(1, int(level.max(initial=0)) + 1):
        for at, bits in _places(keys[level >= now], now, len(filter_)):
            np.bitwise_or.at(filter_, at, bits)
    return filter_


def read_levels(filter_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The level of each key: levels are asked for in turn, those that have one go on to the next."""
    level, alive = np.zeros(len(keys), np.int64), np.arange(len(keys))
    now = 1
    while len(alive):
        there = np.ones(len(alive), bool)
        for at, bits in _places(keys[alive], now, len(filter_)):
            there &= filter_[at] & bits == bits
        alive = alive[there]
        level[alive] = now
        now += 1
    return level


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> _HALF) * np.uint64(shards)) >> _HALF


def _packed(kind: int, keys: np.ndarray, counts: np.ndarray, shards: int) -> list[tuple]:
    """kind, shard, keys, counts of sorted keys, a row for each shard that has some: shards are ranges of keys."""
    edges = np.searchsorted(_shard(keys, shards), np.arange(shards + 1))
    return [(kind, s, keys[a:b].tobytes(), counts[a:b].tobytes()) for s, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)) if b > a]


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different keys and the sums of their counts."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
    return keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts


@dataclass(frozen=True)
class Model:
    """shards: table of kind, shard, data (of words their number, keys, counts and followers, of pairs the filter). total: N, different: V."""

    shards: DataFrame
    n_shards: int
    total: int
    different: int
    discount: float
    size: int
    cached: dict = field(default_factory=dict)


def fit(documents: DataFrame, held_out: Column, text: str = "text") -> Model:
    """Counts of all tokens and pairs of texts that aren't held out.

    Each task sorts and counts TEXT bytes at a time, so a frequent token is a number before anything is shuffled; a shard
    gets about as many keys as SHARD_CHARS of text have, however large the input. Null and empty texts are an end alone;
    repeated rows count again.
    """
    texts = documents.select(F.col(text).cast("binary").alias("text"), held_out.alias("held")).where(~F.coalesce(F.col("held"), F.lit(False)))
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, math.ceil(chars / SHARD_CHARS))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, some in _pieces(batches, 0, 0):
            found, _ = tokens(some)
            rows: list[tuple] = []
            for kind, keys in ((WORDS, found), (PAIRS, pairs(found))):
                keys, times = np.unique(keys, return_counts=True)
                rows += _packed(kind, keys, times.astype(np.uint32), shards)
            yield from _batches(rows, ("kind", "shard", "keys", "counts"))
        give_back()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each shard's words their counts; of its pairs the filter, how many were seen once and twice, and the followers."""

        def out(kind: int, shard: int, rows: list[dict]) -> Iterator[tuple]:
            own, times = _added(*(np.frombuffer(b"".join(r[c] for r in rows), t) for c, t in (("keys", np.uint64), ("counts", np.uint32))))
            if kind == WORDS:
                yield kind, shard, int(times.sum()), len(own), own.tobytes(), times.tobytes()
                return
            yield kind, shard, int((times == 1).sum()), int((times == 2).sum()), bloom(own, times).tobytes(), b""
            before, follow = np.unique(own << _HALF, return_counts=True)
            for row in _packed(FOLLOWERS, before, follow, shards):
                yield *row[:2], 0, 0, *row[2:]

        for rows in _together(batches):
            yield from _batches(out(*rows[0], rows[1]), ("kind", "shard", "a", "b", "keys", "counts"))
        give_back()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each shard of words with the number of different tokens that follow each."""
        for (_, shard), rows in _together(batches, by_kind=False):
            words = next((r for r in rows if r["kind"] == WORDS), {"keys": b"", "counts": b""})
            before, follow = _added(*(np.frombuffer(b"".join(r[c] for r in rows if r["kind"] == FOLLOWERS), t) for c, t in (("keys", np.uint64), ("counts", np.int64))))
            own = np.frombuffer(words["keys"], np.uint64)
            values = [np.frombuffer(words["counts"], np.int64), _found(before, follow, own & ~_LOW)]
            wide = np.int64 if values[0].max(initial=0) >> 32 else np.uint32  # nothing follows a word more often than it stands there
            data = np.int64(len(own)).tobytes() + words["keys"] + b"".join(v.astype(wide).tobytes() for v in values)
            yield from _batches([(WORDS, shard, data)], ("kind", "shard", "data"))

    spark, table = documents.sparkSession, "kind int, shard long, a long, b long, keys binary, counts binary"
    with arrow_rows(spark, 500):
        counted = texts.select("text").mapInArrow(count, "kind int, shard long, keys binary, counts binary")
        built = stash(counted.repartition(2 * shards, "kind", "shard").sortWithinPartitions("kind", "shard").mapInArrow(build, table), "lm")
        halves = built.where(F.col("kind") != PAIRS).select("kind", "shard", "keys", "counts").repartition(shards, "shard").sortWithinPartitions("shard", "kind")
        words = stash(halves.mapInArrow(join, "kind int, shard long, data binary"), "lm")
    of = lambda kind, c: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col(c))), F.lit(0))
    total, different, once, twice = built.agg(*(of(kind, c) for kind in (WORDS, PAIRS) for c in "ab")).first()
    filters = built.where(F.col("kind") == PAIRS).select("kind", "shard", F.col("keys").alias("data"))
    shards_ = words.unionByName(filters)
    least, most = DISCOUNTS
    discount = min(most, max(least, once / (once + 2 * twice))) if once else most
    return Model(shards_, shards, total, different, discount, shards_.agg(F.sum(F.length("data"))).first()[0] or 0)


def _together(batches: Iterator[pa.RecordBatch], by_kind: bool = True) -> Iterator[tuple[tuple, list[dict]]]:
    """Kind and shard, and its rows, of rows in that order: one shard at a time in memory."""
    now, rows = None, []
    for b in batches:
        for row in b.to_pylist():
            own = (row["kind"] if by_kind else None, row["shard"])
            if rows and own != now:
                yield now, rows
                rows = []
            now = own
            rows.append(row)
    if rows:
        yield now, rows


def _batches(rows: Iterator[tuple] | list[tuple], names: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Record batches of up to 1,000 rows of whole numbers and bytes; the first number, the kind, has 32 bits."""
    rows = iter(rows)
    while some := list(islice(rows, 1000)):
        columns = [pa.array(c, pa.binary() if isinstance(c[0], bytes) else pa.int32() if n == "kind" else pa.int64()) for n, c in zip(names, zip(*some, strict=True), strict=True)]
        yield pa.RecordBatch.from_arrays(columns, names=list(names))


def _found(own: np.ndarray, values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The value of each key; 0 for one that isn't among the sorted own keys."""
    if not len(own):
        return np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
    return np.where(own[at] == keys, values[at], 0)


def _answer(kind: int, data: bytes, keys: np.ndarray) -> np.ndarray:
    """A row for each key: of words the count and the followers, of pairs the level."""
    if kind == PAIRS:
        return read_levels(np.frombuffer(data, np.uint64), keys)[:, None]
    n = int(np.frombuffer(data, np.int64, 1)[0])
    own = np.frombuffer(data, np.uint64, n, 8)
    values = np.frombuffer(data, np.uint32 if len(data) == 8 + 16 * n else np.int64, 2 * n, 8 + 8 * n)
    return np.stack([_found(own, values[:n], keys), _found(own, values[n:], keys)], 1).astype(np.int64)


def _scored(lengths: np.ndarray, values: np.ndarray, level: np.ndarray, total: int, different: int, discount: float) -> list[np.ndarray]:
    """n_tokens, n_known, train_tokens, base_score and score of texts that lie end to end. values: count and followers of every token, level: of every pair."""
    starts, count = np.cumsum(lengths) - lengths, values[:, 0]
    alone = (count + 0.5) / (total + 0.5 * (different + 1))
    before, followers = np.concatenate([[[0, 0]], values[:-1]]).T
    before[starts], followers[starts] = values[starts + lengths - 1].T  # an end stands before each text
    both = np.minimum(MIDDLE[level], np.minimum(before, count))  # no more often than either token
    some = np.maximum(before, 1)
    p = np.where(before > 0, np.maximum(both - discount, 0) / some + discount * np.clip(followers, 1, some) / some * alone, alone)
    return [lengths, np.add.reduceat((count > 0).astype(np.int64), starts), np.full(len(lengths), total), np.add.reduceat(np.log10(alone), starts), np.add.reduceat(np.log10(p), starts)]


def score(documents: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), prefix: str = "", limit: int = FILTER_BYTES) -> DataFrame:
    """The columns of `keep`, and n_tokens, n_known, train_tokens, base_score and score of each whole text.

    Tokens are words, A-Z lower-cased, and an end. base_score sums log10 of (c + 1/2) / (N + (V + 1) / 2), c being the exact
    count of a token in training; n_known counts those with c > 0. score sums log10 of the token's probability behind
    the one before (the first: behind an end), by absolute discounting: (c - D) / n + D * T / n * the token's own, c being the
    pair's count as read from the filter, and no higher than either token's, n the exact count of the token before and T how
    many different tokens follow it; D is n1 / (n1 + 2 n2) of the pairs seen once and twice. Behind a token that training
    doesn't have, the token's own probability counts. Null and empty texts are an end alone; null ids and repeated rows are rows like
    others; long texts are read whole; further columns are ignored; an empty table gives none. Without training texts every
    token has probability 1.
    """
    names = {"n_tokens": T.LongType(), "n_known": T.LongType(), "train_tokens": T.LongType(), "base_score": T.DoubleType(), "score": T.DoubleType()}
    schema = schema_of(documents, keep, **{f"{prefix}{k}": t for k, t in names.items()})
    return _by_broadcast(documents, model, keep, schema) if model.size <= limit else _by_shuffle(documents, model, keep, schema)


def _pieces(batches: Iterator[pa.RecordBatch], at: int, n: int) -> Iterator[tuple[list[pa.Array], list[bytes]]]:
    """The first n columns, and the texts in column `at`, of about TEXT bytes of text at a time."""
    for b in batches:
        texts = b.column(at).cast(pa.binary())
        start = 0
        while start < b.num_rows:
            end, size, some = start, 0, []
            while end < b.num_rows and size < TEXT:
                some.append(texts[end].as_py() or b"")
                size, end = size + len(some[-1]), end + 1
            yield [c.slice(start, end - start) for c in b.columns[:n]], some
            start = end


def _sent(spark: SparkSession, shards: DataFrame) -> Iterator[Broadcast]:
    """Broadcasts of some shards each; the driver reads a part of the table at a time, and keeps none."""
    some, size = [], 0
    for row in shards.toLocalIterator():
        some.append(tuple(row))
        size += len(row["data"])
        if size >= SENT:
            yield spark.sparkContext.broadcast(some)
            some, size = [], 0
    if some:
        yield spark.sparkContext.broadcast(some)


def _by_broadcast(documents: DataFrame, model: Model, keep: tuple[str, ...], schema: T.StructType) -> DataFrame:
    spark = documents.sparkSession
    if "all" not in model.cached:
        model.cached["all"] = list(_sent(spark, model.shards))
    everything, shards, of = model.cached["all"], model.n_shards, (model.total, model.different, model.discount)
    rows, at = with_text(documents, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_shard = {(kind, shard): data for sent in everything for kind, shard, data in sent.value}

        def ask(kind: int, keys: np.ndarray) -> np.ndarray:
            own, place = np.unique(keys, return_inverse=True)
            edges, out = np.searchsorted(_shard(own, shards), np.arange(shards + 1)).tolist(), np.zeros((len(own), 2 if kind == WORDS else 1), np.int64)
            for s in range(shards):
                if edges[s + 1] > edges[s] and (kind, s) in of_shard:
                    out[edges[s] : edges[s + 1]] = _answer(kind, of_shard[kind, s], own[edges[s] : edges[s + 1]])
            return out[place]

        for columns, texts in _pieces(batches, at, len(keep)):
            found, lengths = tokens(texts)
            scores = _scored(lengths, ask(WORDS, found), ask(PAIRS, pairs(found))[:, 0], *of)
            yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, scores)], names=schema.names)
        give_back()

    return rows.mapInArrow(run, schema)


def _by_shuffle(documents: DataFrame, model: Model, keep: tuple[str, ...], schema: T.StructType) -> DataFrame:
    """Pieces of the table, written with their different keys, send these to the shards and put the answers back in place."""
    spark, shards, of = documents.sparkSession, model.n_shards, (model.total, model.different, model.discount)
    rows, at = with_text(documents, keep)
    own = unused("lm_", keep)
    number = T.LongType()
    kept_ = T.StructType([T.StructField(c, T.ArrayType(documents.schema[c].dataType)) for c in keep])
    binary = [f"{own}{c}" for c in ("lengths", "words", "pairs", "word_at", "pair_at")]
    asked_schema = T.StructType([T.StructField(f"{own}piece", number), *(T.StructField(c, T.BinaryType()) for c in binary), *kept_])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        piece = TaskContext.get().partitionId() << 32
        for columns, texts in _pieces(batches, at, len(keep)):
            found, lengths = tokens(texts)
            (words, word_at), (twos, pair_at) = (np.unique(x, return_inverse=True) for x in (found, pairs(found)))
            values = [lengths, words, twos, word_at.astype(np.uint32), pair_at.astype(np.uint32)]
            listed = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), pa.concat_arrays([c])) for c in columns]
            yield pa.RecordBatch.from_arrays([pa.array([piece]), *(pa.array([v.tobytes()], pa.binary()) for v in values), *listed], names=asked_schema.names)
            piece += 1

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece, *keys in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for kind in (WORDS, PAIRS):
                    k = np.frombuffer(keys[kind], np.uint64)
                    yield from _batches(((kind, s, piece, own) for _, s, own, _ in _packed(kind, k, k[:0], shards)), ("kind", "shard", "piece", "data"))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, data = None, b""
        for b in batches:
            out = []
            for row in b.to_pylist():
                if row["piece"] is None:  # a shard stands before its questions
                    shard, data = (row["kind"], row["shard"]), row["data"]
                    continue
                keys = np.frombuffer(row["data"], np.uint64)
                none = np.zeros((len(keys), 2 if row["kind"] == WORDS else 1), np.int64)
                found = _answer(row["kind"], data, keys) if (row["kind"], row["shard"]) == shard else none
                out.append((row["piece"], row["kind"], row["shard"], (found if row["kind"] == WORDS else found.astype(np.uint8)).tobytes()))
            yield from _batches(out, ("piece", "kind", "shard", "found"))

    def put_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A piece, then its answers in order of shards: one piece at a time in memory."""
        piece, got = None, {WORDS: [], PAIRS: []}

        def out() -> pa.RecordBatch:
            (lengths, words_at, pairs_at), columns = piece
            words, level = (np.frombuffer(b"".join(got[kind]), t) for kind, t in ((WORDS, np.int64), (PAIRS, np.uint8)))
            scores = _scored(lengths, words.reshape(-1, 2)[words_at], level[pairs_at], *of)
            return pa.RecordBatch.from_arrays([*columns, *map(pa.array, scores)], names=schema.names)

        for b in batches:
            for k, kind in enumerate(b.column(1).to_pylist()):
                if kind in got:
                    got[kind].append(b.column(3)[k].as_py())
                    continue
                if piece:
                    yield out()
                numbers = [np.frombuffer(b.column(4 + i)[k].as_py(), t) for i, t in enumerate((np.int64, np.uint32, np.uint32))]
                piece, got = (numbers, [b.column(7 + i)[k].values for i in range(len(keep))]), {WORDS: [], PAIRS: []}
        if piece:
            yield out()
        give_back()

    with arrow_rows(spark, 2000):
        asked = stash(rows.mapInArrow(ask, asked_schema), "asked", **WIDE_ROWS)
    n = asked.count()
    with wide_rows(spark), arrow_rows(spark, 2000):
        sent = asked.select(f"{own}piece", f"{own}words", f"{own}pairs").mapInArrow(send, "kind int, shard long, piece long, data binary")
        both = sent.unionByName(model.shards.withColumn("piece", F.lit(None).cast("long"))).repartition(2 * shards, "kind", "shard").sortWithinPartitions("kind", "shard", "piece")
        answers = both.mapInArrow(answer, "piece long, kind int, shard long, found binary")
        heads = asked.select(F.col(f"{own}piece").alias("piece"), F.lit(-1).alias("kind"), F.lit(-1).cast("long").alias("shard"), F.lit(None).cast("binary").alias("found"), *(f"{own}{c}" for c in ("lengths", "word_at", "pair_at")), *(F.col(c).alias(f"{own}{k}") for k, c in enumerate(keep)))
        together = heads.union(answers.select("*", *(F.lit(None).cast(f.dataType) for f in heads.schema.fields[4:])))
        together = together.repartition(max(1, math.ceil(n / 4)), "piece").sortWithinPartitions("piece", "kind", "shard")
        out = stash(together.mapInArrow(put_back, schema), "scores")
    discard(asked)
    return out
