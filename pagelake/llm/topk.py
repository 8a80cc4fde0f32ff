"""Exact top-k by inner product: score everything, find each k-th value by global score histograms, filter, rank.

Queries and candidates are packed into blocks; a pair of blocks is one row of an equi-join on the pair's number,
scored by one matrix product. Blocks are bounded, so a task's memory is too, and no side is broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelake.llm.store import stash

#: Vectors in a block of candidates and in one of queries.
BLOCK, QUERY_BLOCK = 2048, 1024
#: Bits of a score below the first, coarse histogram's bins.
COARSE_BITS = 12
SCALE = 1024.0
#: Parts stay within this, and scores within 64 bits; the smallest number is no score.
LARGEST, NONE = 9e18, np.iinfo(np.int64).min


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id, v: floor(SCALE * x) of every component, whole; rows with a null or non-finite part are left out. Beyond 9e18 a part stays there."""
    x = F.transform("embedding", lambda x: F.floor(F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), x.cast("double") * SCALE))))
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()).where(whole).select(F.col("vec_id").cast("long"), x.alias("v"))


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """block, ids, dims, data: up to `size` vectors of one length each, in 32 bits a part if that is enough; numbered by task, so nothing moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0
        kept: dict[int, tuple[list, list]] = {}

        def out(dims: int) -> pa.RecordBatch:
            nonlocal made
            ids, data = kept.pop(dims)
            made += 1
            parts = np.array(data, np.int64)
            parts = parts.astype(np.int32) if parts.size and np.abs(parts).max() < 1 << 31 else parts
            values = [[(task << 32) + made], [np.array(ids, np.int64).tobytes()], [dims], [parts.tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int64(), pa.binary(), pa.int32(), pa.binary()), strict=True)], names=["block", "ids", "dims", "data"])

        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids, data = kept.setdefault(len(v), ([], []))
                ids.append(i), data.append(v)
                if len(ids) == size:
                    yield out(len(v))
        for dims in list(kept):
            yield out(dims)

    return rows.mapInArrow(run, "block long, ids binary, dims int, data binary")


def top_k(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best candidates, ties to the smaller vec_id.

    Candidates are all rows but those with the query's own vec_id. Vectors of different lengths don't meet.
    Equal rows (vec_id and vector) count once as query and once as candidate; a vec_id with several vectors
    gives its best. Fewer candidates than k: all of them. Null ids or parts and non-finite parts: left out. Scores are
    exact whole numbers; one beyond 64 bits stays at the largest (or smallest) of them. Further columns are ignored; an
    empty table, or one without a query, gives an empty result.
    """
    rows = stash(quantised(vectors).distinct(), "vectors")
    most = rows.groupBy("vec_id").count().agg(F.max("count")).first()[0] or 1
    # an id's vectors lie side by side and count once a block, so in 1 + ceil((most - 1) / BLOCK) blocks at most:
    # the best `depth` values hold k different ids
    depth = k * (1 + math.ceil((most - 1) / BLOCK))
    cands = stash(_blocks(rows.repartition("vec_id").sortWithinPartitions("vec_id") if most > 1 else rows, BLOCK), "blocks")
    asked = stash(_blocks(rows.where(is_query).repartition(max(1, math.ceil(rows.where(is_query).count() / QUERY_BLOCK))), QUERY_BLOCK), "queries")
    pairs = stash(asked.select(F.col("block").alias("q"), F.col("dims").alias("q_dims")).join(cands.select(F.col("block").alias("c"), "dims"), F.col("q_dims") == F.col("dims")).select("q", "c"), "pairs")
    joined = pairs.join(asked.select(F.col("block").alias("q"), F.col("ids").alias("q_ids"), "dims", F.col("data").alias("q_data")), "q")
    joined = joined.join(cands.select(F.col("block").alias("c"), F.col("ids").alias("c_ids"), F.col("data").alias("c_data")), "c")
    floors: DataFrame | None = None
    for bits in (COARSE_BITS, 0):
        bins = _histogram(joined, floors, bits, depth)
        bins = bins.groupBy("q", "query_id", "bin").agg(F.sum("n").alias("n"))
        above = F.sum("n").over(Window.partitionBy("q", "query_id").orderBy(F.desc("bin")))
        # the bin of the value at `depth`: the last that the best ones reach
        found = bins.withColumn("above", above).where(F.col("above") - F.col("n") < depth).groupBy("q", "query_id").agg((F.min("bin") * (1 << bits)).alias("floor"))
        floors = stash(found.groupBy("q").agg(F.collect_list(F.struct("query_id", "floor")).alias("floors")), "floors")
    best = _scored(joined, floors, k)
    best = best.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _scores(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different query ids and candidate ids and their best scores, whole numbers; a query's own rows have NONE."""
    q_ids, c_ids = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["c_ids"], np.int64)
    s = products(_parts(row["q_data"], len(q_ids), row["dims"]), _parts(row["c_data"], len(c_ids), row["dims"]))
    s[q_ids[:, None] == c_ids[None, :]] = NONE
    c_ids, s = _best(c_ids, s, 1)
    q_ids, s = _best(q_ids, s, 0)
    return q_ids, c_ids, s


def _parts(data: bytes, rows: int, dims: int) -> np.ndarray:
    return np.frombuffer(data, np.int32 if len(data) == 4 * rows * dims else np.int64).reshape(rows, dims)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows: in doubles while these hold every sum, else in 64 bits, else in numbers of any size."""
    large = lambda x: int(max(-int(x.min()), int(x.max()))) if x.size else 0
    most = large(a) * large(b) * a.shape[1]
    if most < 1 << 53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    if most < 1 << 63:
        return a.astype(np.int64) @ b.astype(np.int64).T
    wide = [[sum(x * y for x, y in zip(u, v, strict=True)) for v in b.tolist()] for u in a.tolist()]
    return np.array([[max(NONE + 1, min(-(NONE + 1), x)) for x in r] for r in wide], np.int64).reshape(len(a), len(b))


def _best(ids: np.ndarray, s: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids once each, with their largest scores."""
    names, n = np.unique(ids, return_counts=True)
    if len(names) == len(ids):
        return ids, s
    return names, np.maximum.reduceat(s.take(np.argsort(ids, kind="stable"), axis), np.cumsum(n) - n, axis=axis)


def _floor_of(row: dict, q_ids: np.ndarray) -> np.ndarray:
    known = {f["query_id"]: f["floor"] for f in row.get("floors", ())}
    return np.array([known.get(i, NONE + 1) for i in q_ids.tolist()], np.int64)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for k in range(b.num_rows):
            yield b.slice(k, 1).to_pylist()[0]


def _histogram(joined: DataFrame, floors: DataFrame | None, bits: int, k: int) -> DataFrame:
    """q, query_id, bin, n: counts of scores by bin of 2^bits values.

    Bins below the one of a block's own k-th best are left out: that block alone shows that the global k-th
    value is no lower, so they can't matter, and bins from the global k-th up are complete.
    """
    source = joined if floors is None else joined.join(floors, "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            q_ids, _, s = _scores(row)
            low = _floor_of(row, q_ids)
            if s.shape[1] > k:
                low = np.maximum(low, np.partition(s, -k, axis=1)[:, -k] >> bits << bits)
            at, col = np.nonzero((s >= low[:, None]) & (s > NONE))
            pair = np.stack([q_ids[at], s[at, col] >> bits])
            (ids, bins), n = np.unique(pair, axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), row["q"])), pa.array(ids), pa.array(bins), pa.array(n.astype(np.int64))], names=["q", "query_id", "bin", "n"])

    return source.mapInArrow(run, "q long, query_id long, bin long, n long")


def _scored(joined: DataFrame, floors: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score of all scores from a query's k-th value up; of ties at it, a block's k smallest ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            q_ids, c_ids, s = _scores(row)
            low = _floor_of(row, q_ids)
            order = np.argsort(c_ids, kind="stable")
            s, c_ids = s[:, order], c_ids[order]
            tied = s == low[:, None]
            keep = (s > low[:, None]) | (tied & (np.cumsum(tied, axis=1) <= k))
            at, col = np.nonzero(keep & (s > NONE))
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[at]), pa.array(c_ids[col]), pa.array(s[at, col])], names=["query_id", "vec_id", "score"])

    return joined.join(floors, "q").mapInArrow(run, "query_id long, vec_id long, score long")
