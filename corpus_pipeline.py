"""A corpus pipeline from documents to packed sequences.

Stages: language ID, quality rules, n-gram Jaccard join, mixing sources, best-fit packing. Each works on all
that its predecessor kept and is written as Parquet before the next one reads it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.llm import jaccard, language, mixing, packing, rules
from pagelake.llm.queries import remainder, tokenizer_path
from pagelake.llm.store import drop_folder, shared_dir, unused


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language: null texts, those without a letter and ambiguous ones go.

    Null ids and repeated rows are documents like others. An empty table, or one without a known language, gives none.
    """
    decoder, own = language.fit(docs, remainder(3) == 1), unused("stage_", docs.columns)
    found = language.predict(docs, decoder, keep=tuple(docs.columns), prefix=own)
    return found.where((F.col(f"{own}lang_pred") != language.UNKNOWN) & ~F.col(f"{own}ambiguous")).select(*docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no rule of the strict policy; null and empty texts fail. Null ids and repeated rows stay; an empty table gives none."""
    own = unused("stage_", docs.columns)
    rows = rules.ledger(docs, keep=tuple(docs.columns), prefix=own)
    return rows.where(rules.passes(rules.STRICT, own)).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id, null ids last; repeated rows count once.

    Groups are of texts: two different texts under one id, or without ids, each stay unless another text of their group does.
    Documents without words all stay. An empty table gives none.
    """
    return jaccard.one_of_each(docs).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the one in which a source's budget ends is cut there. Awkward rows: see mixing.mixed_documents."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens and their places. Awkward rows: see packing.pack."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("language_id", identify), ("quality_rules", keep_quality), ("jaccard_join", drop_near_copies), ("mix_sources", mix), ("best_fit_packing", pack)]

#: Classifying, hashing and tokenising are beyond SQL; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; of their tables only the last one, which is the result, stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base, before = f"{shared_dir(spark)}/pagelake-pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{base}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{base}/{name}")
        if before:
            drop_folder(spark, before)
        before = f"{base}/{name}"
    return docs
