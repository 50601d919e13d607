"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import settle


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step. Each neighbourhood is reduced by a pre-aggregated minimum and joined back,
    so that a hub's edges can be dealt out again by a skew join; no neighbourhood is collected."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        near = edges.join(least, "u")
        out = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has an edge.

    edges: columns u, v (any orientation, repeats and loops allowed, nulls ignored).
    Every round ends in a durable checkpoint; rounds grow with the logarithm of the longest
    path. An empty edge table gives an empty result.
    """
    now = settle(
        edges.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )

    def state(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen = state(now)
    if not seen[0]:
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(most_rounds):
        now = settle(_star(_star(now, True), False))
        reached = state(now)
        if reached == seen:
            roots = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = reached
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
