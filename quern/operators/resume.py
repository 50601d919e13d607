"""What is left to do: anti-joins with finished work."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pending(rows: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Rows whose key is not among the finished ones."""
    return rows.join(done.select(*keys).distinct(), list(keys), "left_anti")


def pending_copies(rows: DataFrame, done: DataFrame, key: str, order: str) -> DataFrame:
    """Each finished copy of a fingerprint cancels one pending copy, in order."""
    finished = done.groupBy(key).agg(F.count(F.lit(1)).alias("_done"))
    numbered = rows.withColumn("_copy", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    return numbered.join(finished, key, "left").where(F.col("_copy") > F.coalesce("_done", F.lit(0))).drop("_copy", "_done")


def last_state(log: DataFrame, key: str, order: str) -> DataFrame:
    """The last line of each key: a later line overrides an earlier one."""
    fields = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*fields), F.col(order)).alias("s")).select(key, *[F.col(f"s.{c}").alias(c) for c in fields])


def bad_line_rate(lines: DataFrame, valid: str, most: float = 0.01) -> DataFrame:
    """One row: lines, malformed, rate, and whether the rate is over the bound."""
    out = lines.agg(F.count(F.lit(1)).alias("lines"), F.count_if(~F.col(valid)).alias("malformed"))
    rate = F.coalesce(F.try_divide("malformed", "lines"), F.lit(0.0))
    return out.withColumn("rate", rate).withColumn("flagged", rate > most)
