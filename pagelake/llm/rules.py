"""Quality rules as a ledger: every rule is evaluated once, its failure is a bit, its measurements stay.

A policy is a mask of bits with a version; applying one, or asking what a rule alone removes, needs no text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.llm.store import schema_of, with_text
from pagelake.llm.text import SPACES, WordHashes, give_back, windows, word_hashes

SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_bangs")

#: Failure of each rule by the measurements, in order of bits. Whole numbers only, so any engine agrees.
RULES = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "duplicate_lines": "n_lines >= 4 and 100 * n_dup_lines > 50 * n_lines",
    "long_words": "word_chars > 16 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "shouting": "100 * n_upper > 40 * n_letters and n_letters >= 40",
    "exclamation": "n_bangs >= 10 and 10 * n_bangs > 3 * n_words",
}
BITS = {name: 1 << k for k, name in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BITS[r] for r in self.rules)


BASE = Policy("base-1", ("few_words", "repeated_windows"))
STRICT = Policy("strict-1", tuple(RULES))


def measure(text: bytes, cache: WordHashes) -> tuple[int, ...]:
    """MEASURES of one whole text."""
    words = text.split()
    n = len(words)
    if not n:
        return (0,) * len(MEASURES)
    solid = text.translate(None, SPACES)
    chars = len(solid) if solid.isascii() else len(solid.decode("utf-8", "replace"))
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated = 0
    if n >= 5:
        _, first, count = np.unique(windows(word_hashes(words, cache), 5), return_inverse=True, return_counts=True)
        edge = np.zeros(n + 1, np.int32)
        starts = np.flatnonzero(count[first] > 1)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + 5, -1)
        repeated = int((np.cumsum(edge[:-1]) > 0).sum())
    missing = lambda drop: len(text) - len(text.translate(None, drop))
    upper = missing(bytes(range(65, 91)))
    letters = upper + missing(bytes(range(97, 123)))
    return n, chars, missing(SYMBOLS), len(lines) - len(set(lines)), repeated, len(lines), upper, letters, missing(b"!")


def ledger(documents: DataFrame, keep: tuple[str, ...] = ("doc_id",), prefix: str = "") -> DataFrame:
    """The columns of `keep`, MEASURES (long) and failed (long, a bit a rule) of each document.

    Null, empty and blank texts have 0 everywhere and fail the rules that hold for 0 words. Each row is read on
    its own and whole, however long; repeated rows and null ids stay; an empty table gives an empty ledger. Where
    a column of `keep` has the name of one that is added, a prefix for the added ones is asked for. No shuffle.
    """
    rows, at = with_text(documents, keep)
    names = [prefix + m for m in MEASURES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for b in batches:
            found = np.array([measure(t.as_py() or b"", cache) for t in b.column(at).cast(pa.binary())], np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *[pa.array(found[:, k]) for k in range(len(MEASURES))]], names=[*keep, *names])
        del cache
        give_back()

    schema = schema_of(documents, keep, **dict.fromkeys([*names, f"{prefix}failed"], T.LongType()))
    rows = rows.mapInArrow(run, T.StructType(schema.fields[:-1]))
    measured = {m: f"`{prefix}{m}`" for m in MEASURES}
    fails = [F.when(F.expr(re.sub(r"[a-z_]{5,}", lambda m: measured.get(m[0], m[0]), rule)), F.lit(BITS[name])).otherwise(0) for name, rule in RULES.items()]
    return rows.withColumn(f"{prefix}failed", sum(fails, F.lit(0)).cast("long"))


def passes(policy: Policy, prefix: str = ""):
    """Whether a ledger row fails no rule of the policy."""
    return F.col(f"{prefix}failed").bitwiseAND(F.lit(policy.mask)) == 0


def ablation(rows: DataFrame, policy: Policy) -> DataFrame:
    """rule, failing, only_this (what goes by this rule alone) and with all of the policy's rules, from one pass."""
    hit = F.col("failed").bitwiseAND(F.lit(policy.mask))
    counts = [F.struct(F.lit(r).alias("rule"), F.count_if(hit.bitwiseAND(F.lit(BITS[r])) != 0).alias("failing"), F.count_if(hit == BITS[r]).alias("only_this")) for r in policy.rules]
    all_ = F.struct(F.lit("all").alias("rule"), F.count_if(hit != 0).alias("failing"), F.lit(0).cast("long").alias("only_this"))
    return rows.agg(F.array(*counts, all_).alias("r")).select(F.explode("r").alias("r")).select(F.lit(policy.version).alias("policy"), "r.*")
