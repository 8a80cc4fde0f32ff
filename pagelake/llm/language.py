"""Language ID by error-correcting output codes.

Each language has a codeword; a binary classifier on hashed letter n-grams predicts each bit; the codeword with
the smallest weighted loss under the predicted margins wins. A close second flags the text as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.llm.store import schema_of, with_text
from pagelake.llm.text import give_back

#: Documents that training uses at most, by language and of all languages: those with the smallest CRC-32 of their MD5.
SAMPLE, TOTAL = 1500, 12_000
NGRAM_BINS, EPOCHS, BATCH, RATE = 4096, 12, 64, 0.05
#: The winner's share of the likelihood under which a text counts as ambiguous.
AMBIGUOUS = 0.5
UNKNOWN = "und"
#: A-Z lower-cased; digits, punctuation and controls become blanks; bytes of other letters stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes hashed at once, so that a very long text needs no more memory than this many.
STRIDE = 1 << 20


def ngrams(text: bytes) -> np.ndarray:
    """Square roots of the shares of a text's 1- to 4-byte grams by bin, to unit length; all of the text counts."""
    counts = np.zeros(NGRAM_BINS, np.int64)
    folded = b" " + b" ".join(text.translate(FOLD).split()) + b" "
    raw = np.frombuffer(folded, np.uint8)
    for k in range(0, len(raw), STRIDE):
        part = raw[k : k + STRIDE + 3].astype(np.uint32)
        h = np.zeros(len(part), np.uint32)
        for n in range(4):
            if len(part) <= n:
                break
            h = h[: len(part) - n] * np.uint32(0x01000193) + part[n:] + np.uint32(n + 1)
            own = h[: min(STRIDE, len(h))]
            counts += np.bincount((own * np.uint32(0x9E3779B1)) >> np.uint32(32 - 12), minlength=NGRAM_BINS)
    x = np.sqrt(counts / counts.sum())
    return x.astype(np.float32)


def has_letter(text: bytes) -> bool:
    return any(map(str.isalpha, text.decode("utf-8", "ignore")))


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """n rows of +1 and -1. Up to 5 languages: all splits in two; beyond, the best of many random codes by distance."""
    if n <= 5:
        splits = np.arange(1, 2 ** (n - 1)) if n > 1 else np.array([0])
        return np.array([[1 if s >> i & 1 else -1 for s in splits] for i in range(n)], np.int8)
    rng, bits, best, code = np.random.default_rng(seed), 10 * int(np.ceil(np.log2(n))), -1, None
    for _ in range(200):
        c = rng.choice(np.array([-1, 1], np.int8), (n, bits))
        if (np.abs(c.sum(0)) == n).any():
            continue
        gap = min(int((c[i] != c[j]).sum()) for i in range(n) for j in range(i))
        if gap > best:
            best, code = gap, c
    return code


@dataclass(frozen=True)
class Decoder:
    languages: tuple[str, ...]
    code: np.ndarray
    weights: np.ndarray  # bins x bits
    bias: np.ndarray
    trust: np.ndarray  # of each bit, from its training loss

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and share of the likelihood of each row's nearest codeword."""
        margins = x @ self.weights + self.bias
        loss = np.stack([(np.logaddexp(0, -margins * c) * self.trust).sum(1) for c in self.code], 1)
        like = np.exp(loss.min(1, keepdims=True) - loss)
        return loss.argmin(1), 1 / like.sum(1)


def train(x: np.ndarray, y: np.ndarray, languages: tuple[str, ...], seed: int = 5) -> Decoder:
    code = codewords(len(languages))
    target = code[y].astype(np.float32)  # rows x bits
    rng = np.random.default_rng(seed)
    n, bits = len(y), code.shape[1]
    cost = (n / len(languages) / np.bincount(y, minlength=len(languages)))[y].astype(np.float32)
    w, b = np.zeros((x.shape[1], bits), np.float32), np.zeros(bits, np.float32)
    m, v, step = np.zeros_like(w), np.zeros_like(w), 0
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for k in range(0, n, BATCH):
            i, step = order[k : k + BATCH], step + 1
            a = x[i].astype(np.float32)  # x may be in 16 bits
            g = -target[i] / (1 + np.exp(target[i] * (a @ w + b))) * cost[i][:, None] / len(i)
            grad = a.T @ g + 1e-5 * w
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
            w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            b -= RATE * g.sum(0)
    lost = sum(np.logaddexp(0, -target[k : k + 1000] * (x[k : k + 1000].astype(np.float32) @ w + b)).sum(0) for k in range(0, n, 1000)) / n
    trust = 1 / (lost + 0.01)
    return Decoder(languages, code, w, b, trust / trust.mean())


def fit(documents: DataFrame, held_out: Column, sample: int = SAMPLE) -> Decoder:
    """The decoder from texts with a known language that aren't held out: about `sample` a language at most, and TOTAL of all.

    So the driver's memory doesn't grow with the number of languages. The sample comes from ids alone, by hash; lang is the
    label and no feature. Null texts and languages, and null ids that the fold leaves open, aren't learnt from; an empty text
    counts as one without letters; repeated rows count as often as they are there; further columns are ignored. Without any
    row, all is 'und'.
    """
    key = F.crc32(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).cast("binary"))
    known = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out).select("doc_id", "lang", key.alias("k"))
    sizes = known.groupBy("lang").count().collect()  # one row a language
    total = {r["lang"]: r["count"] for r in sizes}
    # every document of a small language; of a large one those below a bound on the hash, about `sample`
    most = F.create_map(*[F.lit(v) for c in total for v in (c, int(min(1.0, min(sample, TOTAL / len(total)) / total[c]) * 2**32))]) if total else None
    if most is None:
        return Decoder((), np.zeros((0, 1), np.int8), np.zeros((NGRAM_BINS, 1), np.float32), np.zeros(1, np.float32), np.ones(1, np.float32))
    rows = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out).where(key < most[F.col("lang")])
    rows = rows.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), "lang", F.col("text").cast("binary").alias("text")).mapInArrow(_vectors, "doc_id long, lang string, x binary")
    got = sorted((r["doc_id"], r["lang"], bytes(r["x"])) for r in rows.collect())
    languages = tuple(sorted({g[1] for g in got}))
    if not languages:
        return Decoder((), np.zeros((0, 1), np.int8), np.zeros((NGRAM_BINS, 1), np.float32), np.zeros(1, np.float32), np.ones(1, np.float32))
    y = np.array([languages.index(g[1]) for g in got])
    x = np.empty((len(got), NGRAM_BINS), np.float16)
    for k in reversed(range(len(got))):  # a row's bytes go as it is taken
        x[k] = np.frombuffer(got.pop()[2], np.float16)
    return train(x, y, languages)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = [ngrams(t).astype(np.float16).tobytes() for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), pa.array(x, pa.binary())], names=["doc_id", "lang", "x"])
    give_back()


def predict(documents: DataFrame, decoder: Decoder, keep: tuple[str, ...] = ("doc_id",), prefix: str = "") -> DataFrame:
    """The columns of `keep`, and lang_pred, score (0 to 1) and ambiguous of each whole text, however long. No shuffle.

    A null text, one without a letter, or a decoder without languages: 'und', score 0, not ambiguous. Null ids and repeated
    rows are rows like others; an empty table gives an empty result. Where a column of `keep` has the name of one that is
    added, a prefix for the added ones is asked for.
    """
    rows, at = with_text(documents, keep)
    added = {f"{prefix}lang_pred": T.StringType(), f"{prefix}score": T.DoubleType(), f"{prefix}ambiguous": T.BooleanType()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).cast(pa.binary())
            names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            for k in range(0, len(texts), 500):
                part = [(i, t) for i in range(k, min(k + 500, len(texts))) if (t := texts[i].as_py()) and decoder.languages and has_letter(t)]
                if part:
                    best, share = decoder.predict(np.stack([ngrams(t) for _, t in part]))
                    for (i, _), j, s in zip(part, best.tolist(), share.tolist(), strict=True):
                        names[i], scores[i] = decoder.languages[j], s
            close = [n != UNKNOWN and s < AMBIGUOUS for n, s in zip(names, scores, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(close, pa.bool_())], names=[*keep, *added])
        give_back()

    return rows.mapInArrow(run, schema_of(documents, keep, **added))
