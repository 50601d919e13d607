"""Question-answer rows from step tables, one function for each family that needs only steps.

steps: (item, step_id, step_goal) and what a family names. Questions come from templates that a
hash of the item picks; evidence is named, not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.leak import has_leak
from quern.functions.text import first_text, literal_array, overlap_coefficient, template_pick, terms, words
from quern.plans.dims import NAMES
from quern.plans.steps import middle_steps, next_k, next_pairs

TEMPLATES = {
    8: ["What is the overall goal of this activity?", "Which goal do all these steps serve?", "What is the person trying to achieve?"],
    10: ["Which step does this clip show?", "What is the aim of the step in this clip?"],
    11: ["Which action is done here?", "Name the action of this clip in a few words."],
    13: ["Why is this step needed?", "What is this step good for?"],
    14: ["Does the second clip depend on the first, and how?", "What does the first step make possible for the second?"],
    15: ["What comes next?", "Which step follows these?"],
    16: ["Which steps lie between the two clips?", "Fill in the steps between the first and the last clip."],
    17: ["Which are the next steps?", "Name the steps that follow."],
    19: ["What would happen if this went otherwise?", "What follows if the condition is changed?"],
    20: ["This step failed. How can it be recovered?", "What should be done after this failure?"],
}
FLAWS = ["goal_inconsistent", "granularity_mismatch", "precondition_missing", "redundant_step", "wrong_ordering"]


def _question(task: int, *key: Column) -> Column:
    options = TEMPLATES[task]
    return F.element_at(literal_array(options), (template_pick(len(options), *key) + 1).cast("int"))


def _rows(frame: DataFrame, task: int, step: Column, answer: Column, evidence: Column) -> DataFrame:
    # exploding the one answer, if it is fit, works it out once; a filter on it would repeat it
    fit = F.filter(F.array(F.trim(answer)), lambda a: a.isNotNull() & (a != "") & ~has_leak(a))
    return frame.select(
        F.lit(NAMES[task]).alias("task_name"), "item", step.cast("long").alias("step_id"), _question(task, F.lit(task), F.col("item"), step).alias("question"), F.explode(fit).alias("answer"), evidence.alias("evidence")
    )


def _prefix(step: Column) -> Column:
    return F.concat(F.lit("prefix_step"), step.cast("string"))


def _clip(step: Column) -> Column:
    return F.concat(F.lit("clip_of_step"), step.cast("string"))


def goal_recognition(plans: DataFrame) -> DataFrame:
    """One row for each plan (item, high_level_goal, n_steps)."""
    return _rows(plans, 8, F.lit(0), F.col("high_level_goal"), _prefix(F.col("n_steps")))


def step_goals(steps: DataFrame) -> DataFrame:
    return _rows(steps, 10, F.col("step_id"), F.col("step_goal"), _clip(F.col("step_id")))


def rationales(steps: DataFrame) -> DataFrame:
    """Rationales (column rationale) of four words or more."""
    return _rows(steps.where(F.size(words(F.coalesce("rationale", F.lit("")))) >= 4), 13, F.col("step_id"), F.col("rationale"), _clip(F.col("step_id")))


def dependencies(steps: DataFrame, most: float = 0.8) -> DataFrame:
    """Adjacent steps of which the second is marked dependent (independence = 'yes'), unless their goals nearly agree."""
    own = steps.select("item", F.col("step_id").alias("next_id"), "independence")
    pairs = next_pairs(steps).join(own, ["item", "next_id"]).where("independence = 'yes'")
    pairs = pairs.where(overlap_coefficient(terms(F.col("step_goal")), terms(F.col("next_goal"))) <= most)
    return _rows(pairs, 14, F.col("next_id"), F.concat(F.col("step_goal"), F.lit(" -> "), F.col("next_goal")), F.concat_ws("+", _clip(F.col("step_id")), _clip(F.col("next_id"))))


def next_steps(steps: DataFrame, least_steps: int = 3) -> DataFrame:
    n = steps.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    return _rows(next_pairs(steps).join(n, "item").where(F.col("n") >= least_steps), 15, F.col("step_id"), F.col("next_goal"), _prefix(F.col("step_id")))


def middle_infill(steps: DataFrame) -> DataFrame:
    return _rows(middle_steps(steps), 16, F.lit(0), F.col("middle_goals"), F.lit("first_and_last_clip"))


def next_k_steps(steps: DataFrame) -> DataFrame:
    return _rows(next_k(steps), 17, F.col("step_id"), F.col("next_goals"), _prefix(F.col("step_id")))


def counterfactuals(steps: DataFrame) -> DataFrame:
    """Outcomes (expected_outcome) of challenges."""
    return _rows(steps.where(first_text(F.col("challenge")) != ""), 19, F.col("step_id"), F.col("expected_outcome"), _clip(F.col("step_id")))


def recoveries(steps: DataFrame) -> DataFrame:
    """Recovery strategies of failures."""
    return _rows(steps.where(first_text(F.col("failure_reason")) != ""), 20, F.col("step_id"), F.col("recovery_strategy"), _clip(F.col("step_id")))


def bad_plans(steps: DataFrame, pool: DataFrame, size: int = 3, least_steps: int = 5) -> DataFrame:
    """(item, flaw, flaw_step, bad_plan, repair) for each item of `least_steps` steps and each flaw.

    A window of `size` consecutive goals, chosen by hash, is spoilt at one position: a goal of
    another plan (from pool: place, goal), a vague one, a later one, an earlier one, or two
    neighbours swapped. Choices are hashes of item and flaw instead of a random sequence. Flaws
    that would leave the window as it was give no row.
    """
    listed = F.transform(F.array_sort(F.collect_list(F.struct("step_id", "step_goal"))), lambda x: x["step_goal"])
    plans = steps.groupBy("item").agg(listed.alias("goals")).where(F.size("goals") >= least_steps)
    rows = plans.withColumn("flaw", F.explode(literal_array(FLAWS)))
    n = F.size("goals")
    first = (F.lit(1) + F.pmod(template_pick(1 << 30, F.col("item"), F.col("flaw"), F.lit("start")), (n - size - 1).cast("long"))).cast("int")
    rows = rows.withColumns({"start": first, "at": (template_pick(size - 1, F.col("item"), F.col("flaw"), F.lit("at")) + 1).cast("int")})
    total = pool.count()
    rows = rows.withColumn("place", F.pmod(template_pick(1 << 30, F.col("item"), F.lit("pool")), F.lit(max(1, total))) + 1)
    rows = rows.join(pool.select("place", F.col("goal").alias("other")), "place", "left")
    window = F.slice("goals", F.col("start") + 1, F.lit(size))
    rows = rows.withColumn("repair", window)
    swap = lambda x, i: F.when(i + 1 == F.col("at"), F.get("repair", F.col("at"))).when(i == F.col("at"), F.get("repair", F.col("at") - 1)).otherwise(x)
    put = lambda new: (lambda x, i: F.when(i + 1 == F.col("at"), new).otherwise(x))
    bad = (
        F.when(F.col("flaw") == "goal_inconsistent", F.transform("repair", put(F.col("other"))))
        .when(F.col("flaw") == "granularity_mismatch", F.transform("repair", put(F.lit("Do what is needed."))))
        .when(F.col("flaw") == "precondition_missing", F.transform("repair", put(F.get("goals", F.col("start") + size))))
        .when(F.col("flaw") == "redundant_step", F.transform("repair", put(F.get("goals", F.col("start") - 1))))
        .otherwise(F.transform("repair", swap))
    )
    rows = rows.withColumn("bad", bad)
    inside = F.exists("goals", lambda g: g == F.col("other"))
    rows = rows.where((F.col("bad") != F.col("repair")) & ~((F.col("flaw") == "goal_inconsistent") & (F.col("other").isNull() | inside)))
    return rows.select("item", "flaw", F.col("at").alias("flaw_step"), F.array_join("bad", " | ").alias("bad_plan"), F.array_join("repair", " | ").alias("repair"))


def key_moments(steps: DataFrame) -> DataFrame:
    """First keyframe row of each distinct answer in an item: (item, step_id, place, answer) with place the order."""
    w = Window.partitionBy("item", "answer").orderBy("step_id", "place")
    return steps.where(F.length("answer") >= 15).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
