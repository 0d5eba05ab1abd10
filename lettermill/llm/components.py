"""Connected components of a graph given as edges, by alternating stars until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.llm.common import checkpointed


def _least(pairs: DataFrame) -> DataFrame:
    """For each `a` the least of its `b`; a partial minimum is taken before the shuffle."""
    return pairs.groupBy("a").agg(F.min("b").alias("m"))


def _signature(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node with an edge; root is the least node that it reaches.

    edges: columns a and b of one orderable type; repeats, both directions and loops do no harm. Each round a node's
    larger neighbours are hung on its least one, then its smaller ones too, so long chains shorten by a power.
    Rounds start from a checkpoint. No node's neighbours are gathered: only minima per node are joined back.
    """
    edges = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = checkpointed(edges)
    before = _signature(edges)
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        larger = both.join(_least(both), "a").where(F.col("b") > F.col("a"))
        larger = larger.select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        smaller = larger.join(_least(larger), "a")
        stars = smaller.select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b"))
        edges = checkpointed(smaller.select("a", F.col("m").alias("b")).unionByName(stars).distinct())
        after = _signature(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components still change after {rounds} rounds")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
