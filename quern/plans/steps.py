"""Windows over the steps of a plan: a table (item, step_id, step_goal, ...), one row for each step."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _in_order():
    return Window.partitionBy("item").orderBy("step_id")


def _whole():
    return Window.partitionBy("item")


def neighbours(steps: DataFrame) -> DataFrame:
    """Goals of the step before and after."""
    return steps.withColumns({"prev_goal": F.lag("step_goal").over(_in_order()), "next_goal": F.lead("step_goal").over(_in_order())})


def next_pairs(steps: DataFrame) -> DataFrame:
    """(item, step_id, step_goal, next_id, next_goal) of adjacent steps."""
    w = _in_order()
    return steps.withColumns({"next_id": F.lead("step_id").over(w), "next_goal": F.lead("step_goal").over(w)}).where("next_id is not null").select("item", "step_id", "step_goal", "next_id", "next_goal")


def next_k(steps: DataFrame, least_steps: int = 4) -> DataFrame:
    """(item, step_id, k, next_goals): the next k steps in one text.

    k is 6 at most and 3 at least, but never more than remain; plans of fewer than `least_steps` give none.
    """
    w = _in_order()
    after = F.collect_list("step_goal").over(w.rowsBetween(1, 6))
    rows = steps.withColumns({"n": F.count(F.lit(1)).over(_whole()), "place": F.row_number().over(w), "after": after})
    left = F.col("n") - F.col("place")
    k = F.least(F.greatest(F.lit(3), F.least(F.lit(6), left)), left).cast("int")
    return rows.where((F.col("n") >= least_steps) & (left > 0)).select("item", "step_id", k.alias("k"), F.array_join(F.slice("after", F.lit(1), k), " | ").alias("next_goals"))


def middle_steps(steps: DataFrame, most: int = 8) -> DataFrame:
    """(item, n_middle, middle_goals): steps but the first and the last, `most` at most, of plans of three or more."""
    rows = steps.withColumns({"place": F.row_number().over(_in_order()), "n": F.count(F.lit(1)).over(_whole())})
    inner = rows.where((F.col("place") > 1) & (F.col("place") < F.col("n")) & (F.col("place") <= most + 1))
    listed = F.array_sort(F.collect_list(F.struct("place", "step_goal")))
    return inner.groupBy("item").agg(F.count(F.lit(1)).alias("n_middle"), listed.alias("s")).select("item", "n_middle", F.array_join(F.transform("s", lambda x: x["step_goal"]), " | ").alias("middle_goals"))


def prefixes(steps: DataFrame) -> DataFrame:
    """(item, step_id, prefix): ids of all steps up to this one."""
    ids = F.collect_list(F.col("step_id").cast("string")).over(_in_order().rowsBetween(Window.unboundedPreceding, 0))
    return steps.select("item", "step_id", F.array_join(ids, ",").alias("prefix"))


def goal_pool(steps: DataFrame, seed: str = "42") -> DataFrame:
    """(goal, first_item, place): distinct goals, placed by a seeded hash instead of a shuffle."""
    from quern.operators.rank import global_rank

    distinct = steps.groupBy(F.col("step_goal").alias("goal")).agg(F.min("item").alias("first_item"))
    return global_rank(distinct, F.md5(F.concat(F.lit(seed + ":"), F.col("goal"))), F.col("goal"), name="place")


def first_of_repeats(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each repeated answer."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_n = 1").drop("_n")
