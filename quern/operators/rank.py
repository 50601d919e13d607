"""Ranks over a total order, and what is kept by rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.session import settle


def global_rank(rows: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """rows with their place (from 1) in a total order, without a window over one partition.

    Rows are range-partitioned and sorted; each partition numbers its own, and the sizes of the
    partitions before it (one row for each partition) are added.
    """
    dealt = settle(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.withColumn("_local", local).join(F.broadcast(before), "_part").withColumn(name, (F.col("_local") + F.col("_before")).cast("long")).drop("_part", "_local", "_before")


def keep_count(n: int, fraction: float = 0.5, top_k: int | None = None) -> int:
    """How many of n to keep: top_k at most, else the share rounded half to even, one at least."""
    if not n:
        return 0
    return min(n, top_k) if top_k is not None else max(1, min(n, round(n * fraction)))


def top_fraction(scored: DataFrame, fraction: float = 0.5, top_k: int | None = None) -> DataFrame:
    """Rows (overall, task_name, sample_id, ...) with rank and whether the share keeps them."""
    if not 0 < fraction <= 1:
        raise ValueError("fraction must be over 0 and at most 1")
    scored = settle(scored)  # counted, sampled for ranges and sorted: worked out once
    keep = keep_count(scored.count(), fraction, top_k)
    return global_rank(scored, F.desc("overall"), F.asc("task_name"), F.asc("sample_id")).withColumn("accepted", F.col("rank") <= keep)


def over_thresholds(ranked: DataFrame, overall: float = 75.0, axis: float = 50.0) -> DataFrame:
    """Acceptance also needs an overall score and a lowest axis (column `axes`, an array)."""
    return ranked.withColumn("accepted", F.col("accepted") & (F.col("overall") >= overall) & (F.array_min("axes") >= axis))


def limit_per_group(rows: DataFrame, group: str, order: list[Column], most: int, total: int | None = None) -> DataFrame:
    """The first `most` rows of each group, then the first `total` by group and order."""
    first = rows.withColumn("_place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_place") <= most)
    return (first.orderBy(group, "_place").limit(total) if total is not None else first).drop("_place")


def one_model(scored: DataFrame, model: str = "model") -> DataFrame:
    """Rows scored by one model; raises if there are two, whose scores have no common rank."""
    names = [r[0] for r in scored.select(model).distinct().limit(2).collect()]
    if len(names) > 1:
        raise ValueError(f"scores of several models: {', '.join(sorted(map(str, names)))} ...")
    return scored
