"""Importance resampling towards a target: hashed n-gram buckets, log-ratio gains, Gumbel keys and an exact draw.

Each document becomes a run of 16-bit bucket numbers in a packed stream, written once with the documents' offsets.
Counts come from sorting the stream piece by piece and counting runs; weights from gathering the gains along it.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.llm.store import arrow_rows, discard, small, stash
from pagelake.llm.text import give_back, parts

BUCKETS = 10_000
#: Features, and documents, in one row of a packed stream.
FEATURES, DOCUMENTS = 1 << 20, 5000
#: A-Z lower-cased; what is no ASCII letter or digit, and below 0x80, is a space. Bytes from 0x80 on are parts of words.
_FOLD = bytes(ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(128)) + bytes(range(128, 256))


def features(text: bytes, buckets: int = BUCKETS) -> tuple[np.ndarray, int]:
    """The buckets of all runs of one or two words, and the number of words. A long text goes in parts, its last word carried on."""
    found, n, last = [np.empty(0, np.uint32)], 0, None
    for part in parts(text.translate(_FOLD)):
        words = part.split()
        if not words:
            continue
        single = list(map(crc32, words))
        # the checksum of a pair goes on from the one of its first word
        pairs = map(crc32, [b" " + w for w in words], [last, *single]) if last is not None else map(crc32, [b" " + w for w in words[1:]], single)
        found += [np.array(single, np.uint32), np.fromiter(pairs, np.uint32)]
        n, last = n + len(words), single[-1]
    return (np.concatenate(found) % np.uint32(buckets)).astype(np.uint16), n


def stream(texts: DataFrame, ids: str, buckets: int = BUCKETS) -> DataFrame:
    """Packed rows: ids, words (64-bit numbers), offsets (where each document's features end) and buckets (16-bit numbers)."""
    schema = T.StructType([T.StructField("ids", T.ArrayType(texts.schema[ids].dataType)), *(T.StructField(c, T.BinaryType()) for c in ("words", "offsets", "buckets"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts_, at = b.column(1), 0
            while at < b.num_rows:
                found, words, size, start = [], [], 0, at
                while at < b.num_rows and size < FEATURES and at - start < DOCUMENTS:
                    own, n = features(texts_[at].as_py() or b"", buckets)
                    found.append(own), words.append(n)
                    size, at = size + len(own), at + 1
                own_ids = b.column(0).slice(start, at - start)
                listed = pa.ListArray.from_arrays(pa.array([0, at - start], pa.int32()), pa.concat_arrays([own_ids]))
                packed = [np.array(words, np.int64), np.cumsum([len(f) for f in found], dtype=np.int64), np.concatenate(found)]
                yield pa.RecordBatch.from_arrays([listed, *(pa.array([p.tobytes()], pa.binary()) for p in packed)], names=schema.names)
        give_back()

    with arrow_rows(texts.sparkSession, 2000):
        return stash(texts.select(ids, F.col("text").cast("binary").alias("text")).mapInArrow(run, schema), "stream")


def counts(packed: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket: pieces of the stream are sorted, equal neighbours counted as runs, runs added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for piece in b.column(0):
                s = np.sort(np.frombuffer(piece.as_py(), np.uint16))
                starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])[: len(s)])
                total[s[starts]] += np.diff(np.append(starts, len(s)))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array(total[some])], names=["bucket", "n"])

    with arrow_rows(packed.sparkSession, 50):
        rows = packed.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect()  # `buckets` rows at most
    out = np.zeros(buckets, np.int64)
    for bucket, n in rows:
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(ratio of the smoothed shares of each bucket)): in the target against the source."""
    n = float(len(source))
    ratio = (target + 1.0) * (source.sum() + n) / ((source + 1.0) * (target.sum() + n))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def _weighed(packed: DataFrame, gain: np.ndarray, ids: str) -> DataFrame:
    """ids, n_features, words, weight: the floored mean of the gains over each document's run of the stream."""
    schema = T.StructType([T.StructField(ids, packed.schema["ids"].dataType.elementType), *(T.StructField(c, T.LongType()) for c in ("n_features", "words", "weight"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                words, ends = (np.frombuffer(b.column(c)[k].as_py(), np.int64) for c in (1, 2))
                n, weight = np.diff(ends, prepend=0), np.zeros(len(ends), np.int64)
                some = np.flatnonzero(n)
                if len(some):
                    along = gain[np.frombuffer(b.column(3)[k].as_py(), np.uint16)]
                    weight[some] = np.add.reduceat(along, (ends - n)[some]) // n[some]
                yield pa.RecordBatch.from_arrays([b.column(0)[k].values, *(pa.array(x) for x in (n, words, weight))], names=schema.names)

    with arrow_rows(packed.sparkSession, 50):
        return stash(packed.mapInArrow(run, schema), "weights")


def noise(ids: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)), u from a hash of seed and id: the same for every run. A null id counts as an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(ids.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(documents: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; rank 1, 2, 3, ... for those drawn, null for the others.

    Words are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased; features are runs of one
    or two words, repeats counted. A document's weight is the floored mean of its features' gains (none: 0), its score
    weight plus Gumbel noise; `percent` of the documents with at least least_words words are drawn, by score and then the
    smaller doc_id (null last). Null and empty texts have no features. Repeated rows are documents of their own: they share a
    score and take ranks one after the other. Very long texts are read whole; further columns are ignored. Empty documents
    give an empty result; an empty target has every bucket equally often.

    The 2 * `buckets` counts and the table of different scores are what is sent about. Gains lie within
    1000 ln of a 64-bit count and the noise between -3,131 and 22,875, so there are less than 114,000 different scores: no more
    places than that are broadcast (see store.small). Equal rows are counted before they are ordered, so no score has a hot task.
    """
    packed, aim = stream(documents, "doc_id", buckets), stream(target.select(F.lit(0).alias("id"), "text"), "id", buckets)
    gain = gains(counts(packed, buckets), counts(aim, buckets))
    scored = _weighed(packed, gain, "doc_id").withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    discard(packed), discard(aim)
    tally = scored.where(F.col("words") >= least_words).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    down = Window.orderBy(F.desc("score"))
    drawn = F.floor(F.sum("n").over(Window.partitionBy(F.lit(0))) * percent / 100)
    # of a score: documents before it, and how many are drawn in all; scores that none is drawn from are left out
    places = tally.select(F.col("score").alias("at"), (F.sum("n").over(down) - F.col("n")).alias("before"), drawn.alias("drawn")).where("before < drawn")
    placed = scored.join(small(stash(places, "places")), (F.col("score") == F.col("at")) & (F.col("words") >= least_words), "left")
    columns = ["doc_id", "n_features", "weight", "score"]
    others = placed.where(F.col("before").isNull()).select(*columns, F.lit(None).cast("long").alias("rank"))
    equal = placed.where(F.col("before").isNotNull()).groupBy(*columns, "before", "drawn").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features")
    last = F.col("before") + F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))
    ranked = equal.select(*columns, "drawn", "n", last.alias("last")).withColumn("rank", F.explode(F.sequence(F.col("last") - F.col("n") + 1, "last")))
    return others.unionByName(ranked.select(*columns, F.when(F.col("rank") <= F.col("drawn"), F.col("rank")).alias("rank")))
