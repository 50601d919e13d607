"""Audits of question-answer rows: one row for each issue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.leak import has_leak
from quern.functions.text import share, span_present, terms, words


def shallow_issues(rows: DataFrame) -> DataFrame:
    """(sample_id, task_name, severity, code) of rows (sample_id, task_name, folder, question, answer, n_images, n_videos, evidence_type)."""
    issue = lambda cond, severity, code: F.when(cond, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code")))
    e = F.col("evidence_type")
    found = F.array_compact(
        F.array(
            issue(F.col("folder") != F.col("task_name"), "error", "folder_mismatch"),
            issue(F.trim("question") == "", "error", "empty_question"),
            issue(F.trim("answer") == "", "error", "empty_answer"),
            issue(has_leak(F.col("question")) | has_leak(F.col("answer")), "error", "leak"),
            issue((e == "keyframe_single") & (F.col("n_images") != 1), "error", "evidence_count"),
            issue(e.isin("video_clip", "video_prefix") & (F.col("n_videos") != 1), "error", "evidence_count"),
            issue((e == "video_clip_pair") & (F.col("n_videos") != 2), "error", "evidence_count"),
            issue((F.trim("question") != "") & ~F.endswith(F.trim("question"), F.lit("?")), "warning", "no_question_mark"),
            issue((F.trim("answer") != "") & (F.size(words(F.col("answer"))) < 3), "warning", "short_answer"),
        )
    )
    return rows.select("sample_id", "task_name", F.explode(found).alias("i")).select("sample_id", "task_name", "i.severity", "i.code")


def totals(rows: DataFrame, issues: DataFrame) -> DataFrame:
    """By task: samples, errors, warnings."""
    per = issues.groupBy("task_name").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    return rows.groupBy("task_name").agg(F.count(F.lit(1)).alias("samples")).join(per, "task_name", "left").na.fill(0, ["errors", "warnings"])


def goal_word_share(rows: DataFrame, need: float = 0.5) -> DataFrame:
    """rows (answer, goal) with the share of the goal's words of four letters or more in the answer, and whether it is enough."""
    own = F.filter(F.array_distinct(words(F.lower("goal"))), lambda w: F.length(w) >= 4)
    hit = F.filter(own, lambda w: F.contains(F.lower("answer"), w))
    return rows.withColumn("found", share(F.size(hit), F.size(own))).withColumn("grounded", (F.size(own) == 0) | (F.col("found") >= need))


def ordered_goals(rows: DataFrame) -> DataFrame:
    """rows (answer, goals array) with whether all goals stand in the answer in order."""
    at = F.transform("goals", lambda g: F.call_function("locate", F.lower(g), F.lower(F.col("answer"))))
    ok = F.aggregate(at, F.lit(0), lambda a, x: F.when((a < 0) | (x == 0) | (x < a), F.lit(-1)).otherwise(x))
    return rows.withColumn("in_order", ok >= 0)


def set_equal(rows: DataFrame) -> DataFrame:
    """rows (answer, wanted array, candidates array): the candidates that the answer names are just the wanted ones."""
    named = F.filter("candidates", lambda c: F.contains(F.lower("answer"), F.lower(c)))
    return rows.withColumn("equal", (F.size(F.array_except(named, "wanted")) == 0) & (F.size(F.array_except("wanted", named)) == 0))


def one_off(rows: DataFrame) -> DataFrame:
    """rows (goals, bad arrays): some run of the goals as long as bad differs from it at one place, or two neighbours are swapped."""
    k = F.size("bad")
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("goals") - k)), lambda i: F.slice("goals", i + 1, k))
    off = lambda run: F.filter(F.transform(F.zip_with(run, "bad", lambda a, b: F.coalesce(a != b, F.lit(True))), lambda x, i: F.when(x, i)), lambda x: x.isNotNull())
    one = F.exists(runs, lambda r: (F.size(r) == k) & (F.size(off(r)) == 1))
    swap = F.exists(
        runs,
        lambda r: (F.size(r) == k) & (F.size(off(r)) == 2) & (F.get(off(r), F.lit(1)) == F.get(off(r), F.lit(0)) + 1) & (F.get(r, F.get(off(r), F.lit(0))) == F.get("bad", F.get(off(r), F.lit(1)))) & (F.get(r, F.get(off(r), F.lit(1))) == F.get("bad", F.get(off(r), F.lit(0)))),
    )
    return rows.withColumn("one_off", one | swap)


def grounded_spans(rows: DataFrame) -> DataFrame:
    """rows (answer, spans array) with the spans that the answer does not hold, by the relaxed rule."""
    return rows.withColumn("absent", F.filter("spans", lambda s: (F.size(terms(s)) > 0) & ~span_present(s, F.col("answer"))))


def coverage(rows: DataFrame, item: str, kind: str, every: list[str]) -> DataFrame:
    """(item, have, missing): how many of the kinds an item has rows of, and which it has not."""
    own = rows.where(F.col(kind).isin(every)).select(item, kind).distinct().groupBy(item).agg(F.collect_list(kind).alias("kinds"))
    out = rows.select(item).distinct().join(own, item, "left").withColumn("kinds", F.coalesce("kinds", F.array().cast("array<string>")))
    return out.select(item, F.size("kinds").cast("long").alias("have"), F.array_sort(F.array_except(F.array(*[F.lit(x) for x in every]), F.col("kinds"))).alias("missing"))


def run_counts(plans: DataFrame) -> DataFrame:
    """One row for a run over plans (n_steps, failed): plans, failed, steps of a plan on average and at most."""
    good = F.when(~F.col("failed"), F.col("n_steps"))
    return plans.agg(F.count(F.lit(1)).alias("plans"), F.count_if("failed").alias("failed"), F.round(F.avg(good), 4).alias("steps_per_plan"), F.max(good).alias("most_steps"))


def entities(steps: DataFrame) -> DataFrame:
    """(item, entities): distinct patients of an item's steps (item, step_id, patient), lower-case, in order of their first step."""
    first = steps.where(F.trim(F.coalesce("patient", F.lit(""))) != "").groupBy("item", F.lower(F.trim("patient")).alias("entity")).agg(F.min("step_id").alias("place"))
    return first.groupBy("item").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "entity"))), lambda x: x["entity"]).alias("entities"))


def kept_issues(issues: DataFrame, most: int = 50) -> DataFrame:
    """The first `most` issues of each task by sample and code; counts are taken before, from all."""
    from quern.operators.rank import limit_per_group

    return limit_per_group(issues, "task_name", [F.col("sample_id"), F.col("code")], most)
