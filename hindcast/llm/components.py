"""Connected components of a link table in a few shuffles per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.llm.scratch import kept


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node and root (the smallest node it reaches) for all nodes of ``links`` (columns a, b: long).

    Large star, small star: each round hangs the larger neighbours of every node, then
    the smaller ones and itself, on the smallest node next to it.  All steps are
    aggregates and equi-joins; a hot node's smallest neighbour is found by partial
    aggregation.  Ends when no edge moves; that takes some log2(n) rounds.  Null ends
    and loops do not link.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = kept(edges, "links")
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = kept(small.where("u <> v").distinct(), "links")
        # Stars only: every node has one smaller neighbour, and roots have none.
        state = edges.agg(F.count("*"), F.countDistinct("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    else:
        raise RuntimeError("components did not settle")
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
