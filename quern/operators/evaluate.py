"""Benchmark answers and summaries of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.json import object_of, text_at, unfenced
from quern.functions.scoring import band_100, open_band
from quern.functions.text import let

# Price of a thousand input and output tokens by model.
TOKEN_PRICES = {"model_a": (0.0032, 0.016), "model_b": (0.0006, 0.0036), "model_c": (0.0008, 0.002), "model_d": (0.0, 0.0)}
# Forms in which a chosen letter is given, in order.
LETTER_FORMS = [
    r'(?i)"answer"\s*:\s*"([A-D])"',
    r"(?i)(?:final\s+answer|answer|choice)\s*[:]\s*(?:option\s*)?([A-D])\b",
    r"(?i)(?:choose|select|pick)\s+(?:option\s+)?([A-D])\b",
    r"(?i)\boption\s+([A-D])\b",
    r"(?i)^\s*([A-D])\b",
]


def mcq_letter(response: Column) -> Column:
    """The chosen letter of a response, else null: its JSON answer, a known form, or the last lone letter near the end."""

    def formed(text: Column) -> Column:
        forms = [F.nullif(F.upper(F.regexp_extract(text, p, 1)), F.lit("")) for p in LETTER_FORMS]
        near = F.regexp_extract_all(F.substring(text, F.greatest(F.lit(1), F.length(text) - 399), F.lit(400)), F.lit(r"(?i)\b([A-D])\b"), F.lit(1))
        return F.coalesce(*forms, F.upper(F.try_element_at(near, F.lit(-1))))

    said = let(object_of(response), lambda v: F.upper(text_at(v, "answer")))
    found = let(F.element_at(F.split(unfenced(response), "</think>"), -1), formed)
    return F.when(F.coalesce(response, F.lit("")) == "", F.lit(None)).otherwise(F.coalesce(F.when(said.isin("A", "B", "C", "D"), said), found))


def _ratio(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.round(F.col(part) / F.col(whole), 4)).otherwise(F.lit(0.0))


def mcq_summary(rows: DataFrame, *by: str) -> DataFrame:
    """Counts and accuracies of (predicted, gold), by task or over all."""
    out = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("predicted").isin("A", "B", "C", "D")).alias("answered"),
        F.count_if(F.col("predicted") == F.col("gold")).alias("correct"),
    )
    return out.withColumns({"failed_to_parse": F.col("total") - F.col("answered"), "accuracy": _ratio("correct", "total"), "accuracy_on_answered": _ratio("correct", "answered")})


def mcq_overall(summary: DataFrame) -> DataFrame:
    """Totals over the task summaries."""
    out = summary.agg(*[F.sum(c).alias(c) for c in ("total", "answered", "correct", "failed_to_parse")])
    return out.withColumns({"accuracy": _ratio("correct", "total"), "accuracy_on_answered": _ratio("correct", "answered")})


def open_summary(rows: DataFrame, *by: str) -> DataFrame:
    """Averages of (score or null) over all rows and over valid ones, and counts by band."""
    band = open_band(F.col("score"))
    names = {"parse_error": "parse_errors", "[0.000,0.250)": "band_0", "[0.250,0.500)": "band_1", "[0.500,0.750)": "band_2", "[0.750,1.000]": "band_3"}
    return (
        rows.groupBy(*by)
        .agg(F.count(F.lit(1)).alias("total"), F.count("score").alias("valid"), F.coalesce(F.sum("score"), F.lit(0.0)).alias("s"), *[F.count_if(band == k).alias(v) for k, v in names.items()])
        .withColumns({"average": F.round(F.col("s") / F.col("total"), 4), "average_valid": F.when(F.col("valid") > 0, F.round(F.col("s") / F.col("valid"), 4)).otherwise(0.0)})
        .drop("s")
    )


def open_overall(summary: DataFrame) -> DataFrame:
    """Means of the rounded task means, weighted by their rows."""
    out = summary.agg(F.sum("total").alias("total"), F.sum("valid").alias("valid"), F.sum(F.col("average") * F.col("total")).alias("a"), F.sum(F.col("average_valid") * F.col("valid")).alias("b"))
    return out.select("total", "valid", F.when(F.col("total") > 0, F.round(F.col("a") / F.col("total"), 4)).otherwise(0.0).alias("average"), F.when(F.col("valid") > 0, F.round(F.col("b") / F.col("valid"), 4)).otherwise(0.0).alias("average_valid"))


def score_bands(rows: DataFrame) -> DataFrame:
    return rows.groupBy(band_100(F.col("overall")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


def decision_matrix(rows: DataFrame) -> DataFrame:
    """Decisions counted by task, zeros present."""
    return rows.groupBy("task_name").pivot("decision", ["ACCEPT", "REJECT"]).agg(F.count(F.lit(1))).na.fill(0, ["ACCEPT", "REJECT"])


def duplicate_ids(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def token_cost(rows: DataFrame) -> DataFrame:
    """Tokens and cost by (stage, model), by stage, and in all (nulls); unknown models cost nothing."""
    price = lambda k: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for m, p in TOKEN_PRICES.items() for x in (m, p[k])]), F.col("model")), F.lit(0.0))
    cost = F.col("tokens_in") / 1000 * price(0) + F.col("tokens_out") / 1000 * price(1)
    return rows.withColumn("c", cost).rollup("stage", "model").agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.round(F.sum("c"), 6).alias("cost"))


def missing_groups(rows: DataFrame, item: str, group: str, expected: list[str]) -> DataFrame:
    """Groups that an item has no row of."""
    have = rows.groupBy(item).agg(F.collect_set(group).alias("have"))
    return have.select(item, F.array_sort(F.array_except(F.array(*[F.lit(x) for x in expected]), F.col("have"))).alias("missing"))


def missing_from(rows: DataFrame, item: str, group: str, expected: DataFrame) -> DataFrame:
    """Groups of the table `expected` that an item has no row of; items without one have an empty list."""
    items, have = rows.select(item).distinct(), rows.select(item, group).distinct()
    pair, seen = items.crossJoin(expected).alias("p"), have.alias("h")
    lacking = pair.join(seen, F.col(f"p.{item}").eqNullSafe(F.col(f"h.{item}")) & (F.col(f"p.{group}") == F.col(f"h.{group}")), "left_anti")
    lists = lacking.groupBy(F.col(item).alias("_item")).agg(F.array_sort(F.collect_list(group)).alias("missing"))
    return items.join(lists, items[item].eqNullSafe(F.col("_item")), "left").select(item, F.coalesce("missing", F.array().cast("array<string>")).alias("missing"))


def fill_rate(rows: DataFrame, value: str, most_missing: float = 0.05) -> DataFrame:
    out = rows.agg(F.count(F.lit(1)).alias("total"), F.count(value).alias("filled"))
    return out.withColumns({"missing": F.col("total") - F.col("filled"), "fill_rate": _ratio("filled", "total")}).withColumn("failed", F.col("missing") > F.col("total") * most_missing)
