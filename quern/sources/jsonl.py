"""JSON-lines tables and plan documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(source_file, block, row VARIANT, raw, valid) of all lines that are not blank, from files or folders.

    strict: a line that is no JSON object raises when it is read. Else it stays with valid false, to
    be counted or left out. Large files are read in blocks, each by a task.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(F.col("value").alias("raw"), F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("block")).where(F.trim("raw") != "")
    row = F.try_parse_json("raw")
    out = lines.withColumn("row", F.when(F.startswith(F.schema_of_variant(row), F.lit("OBJECT")), row)).withColumn("valid", F.col("row").isNotNull())
    if strict:
        said = F.concat(F.lit("no JSON object in "), "source_file", F.lit(": "), F.substring("raw", 1, 80))
        out = out.withColumn("valid", F.when(~F.col("valid"), F.raise_error(said).cast("boolean")).otherwise(F.lit(True)))
    return out


def read_tasks(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of the data.jsonl of each task folder (Task_NN... or Task-NN...)."""
    out = read_lines(spark, folder)
    return out.where(F.col("source_file").rlike(r"/Task[_-]?[0-9]+[^/]*/(?:[^/]+/)*data\.jsonl$|/data\.jsonl$"))


def numbered(lines: DataFrame) -> DataFrame:
    """Adds row_index, the place from 0 of a line among those of its file, to rows of `read_lines`.

    A task numbers the lines of its blocks; the lines of a file's earlier blocks are added.
    """
    own = lines.withColumn("_id", F.monotonically_increasing_id())
    blocks = own.groupBy("source_file", "block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("source_file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = blocks.select("source_file", "block", (before - F.col("_first")).alias("_shift"))
    return own.join(placed, ["source_file", "block"]).withColumn("row_index", F.col("_id") + F.col("_shift")).drop("_id", "_shift")


def finished_ids(spark: SparkSession, path: str, key: str = "sample_id") -> DataFrame:
    """Distinct ids of a result file; bad lines are skipped."""
    return read_lines(spark, path, strict=False).where("valid").select(F.try_variant_get("row", f"$.{key}", "string").alias(key)).where(f"{key} is not null").distinct()


def read_plans(spark: SparkSession, folder: str, name: str = "final_plan.json", schema: str | None = None) -> DataFrame:
    """Plan documents of a folder tree with their folder as item."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).option("multiLine", True)
    plans = (reader.schema(schema) if schema else reader).json(folder)
    return plans.withColumn("item", F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", ""))


def step_table(plans: DataFrame) -> DataFrame:
    """(item, pos, step fields ...) of plans with an array of structs `steps`."""
    return plans.select("item", F.posexplode("steps").alias("pos", "s")).select("item", "pos", "s.*")


def read_map(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """(key, value VARIANT) of files that are one JSON object each: their entries."""
    whole = spark.read.option("wholetext", True).text(path).select(F.parse_json("value").alias("v"))
    return whole.select(F.explode(F.from_json(F.to_json("v"), "map<string,variant>")).alias(key, value))
