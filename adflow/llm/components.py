"""Connected components by alternating large-star and small-star rounds.

Each round is two aggregations and two equi-joins on the edges; a node with very
many neighbours is pre-aggregated (a minimum) and its join splits, and nothing
is gathered per node.  Every round is a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adflow.llm.base import Scratch


def _round(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = large.where("u <> v").distinct()           # u > v now
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u")
    return (small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v"))).distinct())


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``node, label``: the least node of its component, for each node of ``edges(u, v)`` (u <> v, both longs)."""
    state = lambda df: df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    now, before, n = edges.select("u", "v"), None, 0
    while True:
        now = scratch.write(_round(now), f"{name}-{n}")
        after = state(now)
        if after == before:
            break
        before, n = after, n + 1
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
