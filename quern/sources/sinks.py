"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_lines(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One compact JSON object in each line; columns in order, nulls written as such."""
    rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode(mode).text(path)


def write_verdicts(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Accepted and rejected rows in folders verdict=.../task_name=..."""
    verdict = F.when(F.col("accepted"), F.lit("accepted")).otherwise(F.lit("rejected"))
    rows.withColumn("verdict", verdict).write.mode(mode).partitionBy("verdict", "task_name").json(path)


def split_issues(issues: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Errors, warnings, and counts by severity."""
    return issues.where("severity = 'error'"), issues.where("severity = 'warning'"), issues.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def removable(folders: DataFrame, plans: DataFrame, force: bool = False) -> DataFrame:
    """Folders (item) without a plan; a report, nothing is deleted. Refuses if no folder would stay."""
    if not force and not folders.join(plans.select("item").distinct(), "item", "left_semi").head(1):
        raise ValueError("no folder has a plan; nothing would stay")
    return folders.join(plans.select("item").distinct(), "item", "left_anti")


def clip_jobs(spans: DataFrame) -> DataFrame:
    """Cut jobs (src, start_sec, duration, dst) of spans (item, step_id, source, start_sec, end_sec); running them is left to others."""
    return spans.select(F.col("source").alias("src"), "start_sec", (F.col("end_sec") - F.col("start_sec")).alias("duration"), F.format_string("%s/step_segments/step%02d.mp4", F.col("item"), F.col("step_id").cast("int")).alias("dst"))


def dead_letters(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows to keep (without `reason`), and those that cannot be saved, with theirs."""
    return rows.where("reason is null").drop("reason"), rows.where("reason is not null")


def backfilled(rows: DataFrame, found: DataFrame, keys: list[str], column: str) -> DataFrame:
    """rows with empty values of a column taken from found (keys, value), and `filled`: whether one was.

    Write the result beside the table it came from, not over it.
    """
    empty = F.trim(F.coalesce(column, F.lit(""))) == ""
    out = rows.join(found.select(*keys, F.col("value").alias("_value")), keys, "left")
    new = F.when(empty, F.col("_value")).otherwise(F.col(column))
    return out.select(*[new.alias(c) if c == column else F.col(c) for c in rows.columns], (empty & F.col("_value").isNotNull()).alias("filled"))
