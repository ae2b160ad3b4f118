"""Connected components of a graph of longs, by alternating stars (large star, then small star) until only stars are left.

A path of n edges takes some log n rounds. Each step is stored in the shared folder and goes with its round, so the edges
of a hub are reduced by partial aggregation before a shuffle, and shuffled for a join by themselves, which lets adaptive
execution split them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, stored

ROUNDS = 60


def _stars(edges: DataFrame) -> bool:
    """Whether every u has one edge and no v is a u: then v is the root of u."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("a"), F.lit(0).alias("b")).union(edges.select("v", F.lit(0), F.lit(1)))
    r = ends.groupBy("n").agg(F.sum("a").alias("a"), F.max("b").alias("b")).agg(F.max("a"), F.max(F.col("a") * F.col("b"))).first()
    return (r[0] or 0) <= 1 and not r[1]


def components(edges: DataFrame) -> DataFrame:
    """edges: columns u, v (long). Gives node, root for every node of an edge; root is its component's least node."""
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(ROUNDS):
        if _stars(now):
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
        both = now.union(now.select("v", "u"))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = stored(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        small = stored(large.groupBy("u").agg(F.min("v").alias("m")), "small")
        down = large.join(small, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, now = now, stored(down.union(small.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(before, least, large, small)
    raise RuntimeError("no convergence")
