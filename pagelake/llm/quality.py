"""Quality classifier: a factorisation machine on hashed words and structure statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.llm.features import STRUCTURE, WORD_BINS, vector
from pagelake.llm.store import schema_of, with_text
from pagelake.llm.text import WordHashes, give_back

#: Labelled documents that training uses at most: those with the smallest CRC-32 of their MD5.
SAMPLE = 6000
RANK, EPOCHS, BATCH, RATE, DECAY = 4, 30, 64, 0.02, 1e-4


@dataclass(frozen=True)
class FactorisationMachine:
    """p = sigmoid(b + w.x + 1/2 sum_f ((V_f.x)^2 - V_f^2.x^2)): all pairs of features in linear time."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray  # features x RANK
    mean: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        x = x - self.mean
        z = self.bias + x @ self.weights + 0.5 * (((x @ self.factors) ** 2).sum(1) - (x * x) @ (self.factors**2).sum(1))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, seed: int = 7) -> FactorisationMachine:
    """Adam on the log loss, both classes with equal weight; the same rows in the same order give the same model."""
    rng = np.random.default_rng(seed)
    mean = np.concatenate([np.zeros(WORD_BINS, np.float32), x[:, WORD_BINS:].mean(0)])
    x = x - mean
    n, d = x.shape
    p = np.concatenate([np.zeros((d, 1)), rng.normal(0, 0.05, (d, RANK))], 1).astype(np.float32)
    bias, first, second, b1, b2, step = 0.0, np.zeros_like(p), np.zeros_like(p), 0.0, 0.0, 0
    share = max(y.mean(), 1e-6), max(1 - y.mean(), 1e-6)
    cost = np.where(y == 1, 0.5 / share[0], 0.5 / share[1]).astype(np.float32)
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for k in range(0, n, BATCH):
            i = order[k : k + BATCH]
            a, step = x[i], step + 1
            inner = a @ p[:, 1:]
            z = bias + a @ p[:, 0] + 0.5 * ((inner**2).sum(1) - (a * a) @ (p[:, 1:] ** 2).sum(1))
            g = (cost[i] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[i]) / len(i)).astype(np.float32)
            grad = np.empty_like(p)
            grad[:, 0] = a.T @ g
            grad[:, 1:] = a.T @ (g[:, None] * inner) - ((a * a).T @ g)[:, None] * p[:, 1:]
            grad += DECAY * p
            first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad * grad
            p -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
            b1, b2 = 0.9 * b1 + 0.1 * float(g.sum()), 0.99 * b2 + 0.01 * float(g.sum()) ** 2
            bias -= RATE * (b1 / (1 - 0.9**step)) / (b2 / (1 - 0.99**step) + 1e-16) ** 0.5
    return FactorisationMachine(float(bias), p[:, 0].copy(), p[:, 1:].copy(), mean)


def crc32_of_id(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def _n_chars(documents: DataFrame) -> Column:
    """The metadata that is a feature; null where the table has none."""
    return (F.col("n_chars") if "n_chars" in documents.columns else F.lit(None)).cast("long").alias("_n_chars_")


def fit(documents: DataFrame, labels: DataFrame, held_out: Column, sample: int = SAMPLE) -> FactorisationMachine:
    """The model from labelled documents that aren't held out: `sample` of them at most, by a hash of the id.

    Only doc_id finds the label; label, lang, source and doc_id are no features; n_chars is one. Null ids and labels other than
    0 and 1 aren't learnt from; null and empty texts are. A label given twice counts as 1 if one is; of repeated rows, texts and
    ids, `sample` rows are taken at most. Further columns are ignored. Without labels of both classes, or rows, the model gives
    everything the share of ones (1/2 without any).
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out)
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    key = F.crc32(F.md5(F.col("doc_id").cast("string").cast("binary")).cast("binary"))
    known = known.orderBy(key, "doc_id").limit(sample)  # a bounded side
    rows = documents.select("doc_id", F.col("text").cast("binary").alias("text"), _n_chars(documents)).join(F.broadcast(known), "doc_id").mapInArrow(_vectors, "doc_id long, quality int, x binary")
    got = sorted((r["doc_id"], r["quality"], bytes(r["x"])) for r in rows.orderBy(key, "doc_id", "x").limit(sample).collect())
    y = np.array([q for _, q, _ in got], np.float32)
    d = WORD_BINS + len(STRUCTURE)
    if not len(y) or y.min() == y.max():
        zero = np.zeros(d, np.float32)
        p = float(y.mean()) if len(y) else 0.5
        return FactorisationMachine(float(np.log((p + 1e-3) / (1 - p + 1e-3))), zero, np.zeros((d, RANK), np.float32), zero)
    return train(np.frombuffer(b"".join(x for *_, x in got), np.float32).reshape(-1, d), y)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = WordHashes()
    for b in batches:
        x = [vector(t or b"", cache, n).tobytes() for t, n in zip(b.column("text").to_pylist(), b.column("_n_chars_").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("quality").cast(pa.int32()), pa.array(x, pa.binary())], names=["doc_id", "quality", "x"])


def score(documents: DataFrame, model: FactorisationMachine, keep: tuple[str, ...] = ("doc_id",), prefix: str = "") -> DataFrame:
    """The columns of `keep`, and score from 0 to 1 of each whole text, however long. No shuffle.

    Null and empty texts get a score too; null ids and repeated rows are rows like others; an empty table gives an empty
    result. Where `keep` has a column score, a prefix for the added one is asked for.
    """
    rows, at = with_text(documents, keep, _n_chars(documents))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for b in batches:
            texts, sizes = b.column(at).cast(pa.binary()), b.columns[-1].to_pylist()
            x = (np.stack([vector(texts[i].as_py() or b"", cache, sizes[i]) for i in range(k, min(k + 2000, len(texts)))]) for k in range(0, len(texts), 2000))
            scores = np.concatenate([model.score(part) for part in x] or [np.empty(0)])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(scores, pa.float64())], names=[*keep, f"{prefix}score"])
        del cache
        give_back()

    return rows.mapInArrow(run, schema_of(documents, keep, **{f"{prefix}score": T.DoubleType()}))
