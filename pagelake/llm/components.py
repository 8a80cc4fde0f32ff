"""Connected components by alternating large-star and small-star contraction; every step is a join and an aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.llm.store import discard, small, stash


#: A node with more edges than this is a hub, whose edges are dealt out to SALTS tasks.
HUB, SALTS = 1_000_000, 64
#: Edges that go into one file, at least.
FILE = 250_000


def _lowest(pairs: DataFrame, hubs: bool) -> DataFrame:
    """pairs (u, v) with m, the smallest of u and its v; combined before the shuffle. With hubs, these meet their m in many tasks."""
    low = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"), "n")
    if not hubs:
        return pairs.join(low, pairs.u == low.k).select("u", "v", "m")
    few = small(low.where(F.col("n") > HUB).select(F.col("k").alias("hub")))
    edges = pairs.join(few, F.col("u") == F.col("hub"), "left").withColumn("salt", F.when(F.col("hub").isNotNull(), F.pmod(F.xxhash64("v"), F.lit(SALTS))).otherwise(0))
    low = low.withColumn("s", F.explode(F.when(F.col("n") > HUB, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return edges.join(low, (F.col("u") == F.col("k")) & (F.col("salt") == F.col("s"))).select("u", "v", "m")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node it reaches) for every node of an edge; loops and nulls are ignored.

    Works for any orderable type. Rounds grow with the logarithm of the longest path; each is written to the
    shared folder, so a lost executor repeats one round at most. Nothing is collected but counts. The
    result is read from the last round's table, which stays; empty tables give none.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    e = stash(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _stars(e):
        n = e.count()
        hubs = n > HUB
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _lowest(both, hubs).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        kept = _lowest(large, hubs)
        new = kept.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("p"))
        new = new.select("p.u", "p.v").where("u <> v").distinct()
        # few edges need few files
        new = stash(new.coalesce(-(-n // FILE)), "edges")
        discard(e)
        e = new
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _stars(e: DataFrame) -> bool:
    """Whether no node has two parents and no parent has one: then parents are the smallest nodes of their components."""
    ends = e.select(F.explode(F.array(F.struct(F.col("u").alias("k"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("k"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("p"))
    return ends.groupBy("p.k").agg(F.sum("p.up").alias("up"), F.max("p.down").alias("down")).where("up > 1 or (up > 0 and down > 0)").isEmpty()
