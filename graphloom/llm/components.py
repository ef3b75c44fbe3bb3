"""Connected components of an edge table, by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(a, b) links of longs in any order -> (node, component): the smallest node reachable, for each node of a link.

    Each round hooks the larger neighbours of a node to its smallest one (large star) and the smaller ones too
    (small star).  The minimum is an aggregate that combines before the shuffle and the hooks are a join that adaptive
    execution can split, so a hub with very many links is no single task's group.  Lineage is cut every round.  No
    links give no rows; loops and repeated links do no harm.  Raises if ``rounds`` do not suffice (the needed number
    grows with the logarithm of the longest path).
    """
    big, small = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    now = checkpoint(edges.select(big, small).where("u > v").distinct())
    seen = _state(now)
    for _ in range(rounds):
        if not seen[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hooked = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = checkpoint(hooked.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        was, seen = seen, _state(now)
        if seen == was:
            break
    else:
        raise RuntimeError(f"components need more than {rounds} rounds")
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
