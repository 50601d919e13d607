"""Frame intervals of steps and actions: half-open, from 1 to the number of frames plus 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def contiguity(spans: DataFrame) -> DataFrame:
    """spans (item, step_id, start, end) with the end before, and gap, overlap or ok."""
    before = F.lag("end").over(Window.partitionBy("item").orderBy("step_id"))
    state = F.when(before.isNull(), F.lit("first")).when(F.col("start") > before, F.lit("gap")).when(F.col("start") < before, F.lit("overlap")).otherwise(F.lit("ok"))
    return spans.withColumns({"prev_end": before, "state": state})


def localization_errors(spans: DataFrame, frames: DataFrame, least: int = 2, most_share: float = 0.6) -> DataFrame:
    """(item, errors): what is wrong with each item's steps, in a fixed order; empty if nothing.

    frames: (item, num_frames). Steps cover 1 to num_frames + 1 without gaps, have `least` frames
    or more and, if there are several, at most a share of all.
    """
    joined = contiguity(spans).join(frames, "item")
    size = F.col("end") - F.col("start")
    per = joined.groupBy("item").agg(
        F.min("start").alias("first"), F.max("end").alias("last"), F.first("num_frames").alias("n"), F.count(F.lit(1)).alias("steps"), F.countDistinct("step_id").alias("ids"),
        F.count_if(F.col("state").isin("gap", "overlap")).alias("breaks"), F.count_if(size < least).alias("short"), F.count_if(size > F.col("num_frames") * most_share).alias("long"),
    )
    checks = [("start", F.col("first") != 1), ("end", F.col("last") != F.col("n") + 1), ("breaks", F.col("breaks") > 0), ("short", F.col("short") > 0), ("long", (F.col("long") > 0) & (F.col("steps") > 1)), ("ids", F.col("ids") != F.col("steps"))]
    return per.select("item", F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks])), ",").alias("errors"))


def atomic_errors(actions: DataFrame, least: int = 2, most: int = 25) -> DataFrame:
    """(item, step_id, errors) of actions (item, step_id, action_id, start, end, step_start, step_end)."""
    w = Window.partitionBy("item", "step_id").orderBy("action_id")
    rows = actions.withColumns({"place": F.row_number().over(w), "before": F.lag("end").over(w)})
    per = rows.groupBy("item", "step_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("action_id") != F.col("place")).alias("ids"), F.count_if(F.col("start") != F.col("before")).alias("breaks"),
        F.min("start").alias("a"), F.max("end").alias("b"), F.first("step_start").alias("x"), F.first("step_end").alias("y"),
    )
    checks = [("count", ~F.col("n").between(least, most)), ("ids", F.col("ids") > 0), ("breaks", F.col("breaks") > 0), ("cover", (F.col("a") != F.col("x")) | (F.col("b") != F.col("y")))]
    return per.select("item", "step_id", F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks])), ",").alias("errors"))


def end_seconds(spans: DataFrame, frames: DataFrame, half_way: bool = True) -> DataFrame:
    """spans (item, step_id, end) with end_sec; frames (item, frame_index, ts).

    The end is the boundary frame's time, or (half_way) half-way from the frame before it; past the
    last frame it is that frame's time plus the smallest positive step between frames.
    """
    w = Window.partitionBy("item").orderBy("frame_index")
    f = frames.withColumns({"before": F.lag("ts").over(w), "last": F.lead("ts").over(w).isNull()})
    step = smallest_step(frames)
    bound = f.select("item", F.col("frame_index").alias("end"), "ts", "before")
    tail = f.where("last").select("item", F.col("ts").alias("last_ts"))
    out = spans.join(bound, ["item", "end"], "left").join(tail, "item").join(step, "item")
    at = F.when(F.col("ts").isNull(), F.col("last_ts") + F.col("delta")).otherwise((F.col("before") + F.col("ts")) / 2 if half_way else F.col("ts"))
    return out.select(*spans.columns, F.round(at, 6).alias("end_sec"))


def smallest_step(frames: DataFrame, least: float = 0.05, default: float = 0.1) -> DataFrame:
    """(item, delta): least positive difference of neighbouring times, `least` at least, `default` without any."""
    w = Window.partitionBy("item").orderBy("ts")
    steps = frames.select("item", "ts").distinct().withColumn("d", F.lead("ts").over(w) - F.col("ts"))
    return steps.groupBy("item").agg(F.coalesce(F.greatest(F.lit(least), F.min(F.when(F.col("d") > 0, F.col("d")))), F.lit(default)).alias("delta"))


def repaired_durations(spans: DataFrame, share: float = 0.9, epsilon: float = 0.01) -> DataFrame:
    """spans (item, step_id, start_sec, end_sec): an end at or before its start moves a share of the way to the next start, or by epsilon."""
    after = F.lead("start_sec").over(Window.partitionBy("item").orderBy("step_id"))
    end = F.when(F.col("end_sec") > F.col("start_sec"), F.col("end_sec")).when(after > F.col("start_sec"), F.col("start_sec") + share * (after - F.col("start_sec"))).otherwise(F.col("start_sec") + epsilon)
    return spans.withColumn("end_sec", end)


def merge_tiny(actions: DataFrame, least: int = 2) -> DataFrame:
    """Actions (item, step_id, action_id, start, end) of which those under `least` frames are merged, renumbered.

    From the first on, one that is too short joins the larger of its neighbours, the one before it
    if they are equal; at the head the one after, at the tail the one before. One alone stays. A
    fold over the few actions of a step, in order.
    """
    spans = F.transform(F.array_sort(F.collect_list(F.struct("action_id", "start", "end"))), lambda x: F.struct(x["start"].cast("long").alias("start"), x["end"].cast("long").alias("end")))
    listed = actions.groupBy("item", "step_id").agg(spans.alias("a"))
    span = lambda x: x["end"] - x["start"]
    none = F.lit(None).cast("long")

    def one(s, i):
        start = F.coalesce(s["carry"], F.get("a", i)["start"])
        end, last, after = F.get("a", i)["end"], F.try_element_at(s["out"], F.lit(-1)), F.get("a", i + 1)
        grown = F.concat(F.slice(s["out"], F.lit(1), F.greatest(F.lit(0), F.size(s["out"]) - 1)), F.array(F.struct(last["start"].alias("start"), end.alias("end"))))
        added = F.concat(s["out"], F.array(F.struct(start.alias("start"), end.alias("end"))))
        back = last.isNotNull() & (after.isNull() | (span(last) >= span(after)))
        return (
            F.when((end - start >= least) | (last.isNull() & after.isNull()), F.struct(added.alias("out"), none.alias("carry")))
            .when(back, F.struct(grown.alias("out"), none.alias("carry")))
            .otherwise(F.struct(s["out"].alias("out"), start.alias("carry")))
        )

    empty = F.struct(F.array().cast("array<struct<start:bigint,end:bigint>>").alias("out"), none.alias("carry"))
    merged = listed.withColumn("m", F.aggregate(F.sequence(F.lit(0), F.size("a") - 1), empty, one, lambda s: s["out"]))
    return merged.select("item", "step_id", F.posexplode("m").alias("p", "x")).select("item", "step_id", (F.col("p") + 1).alias("action_id"), "x.start", "x.end")


def frame_budget(clips: DataFrame, most: int = 50) -> DataFrame:
    """clips (item, place, frames) with how many frames of each fit in the budget, in order."""
    used = F.coalesce(F.sum("frames").over(Window.partitionBy("item").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return clips.withColumn("taken", F.greatest(F.lit(0), F.least(F.col("frames"), F.lit(most) - used)).cast("int"))


def panels(frames: DataFrame, most: int = 50) -> DataFrame:
    """frames (item, frame_index) in at most `most` panels of equal size: (item, panel, label, n)."""
    n = F.count(F.lit(1)).over(Window.partitionBy("item"))
    rows = frames.withColumns({"place": F.row_number().over(Window.partitionBy("item").orderBy("frame_index")), "chunk": F.ceil(n / most)})
    per = rows.withColumn("panel", F.floor((F.col("place") - 1) / F.col("chunk")).cast("int")).groupBy("item", "panel").agg(F.min("frame_index").alias("a"), F.max("frame_index").alias("b"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("frame_index")).alias("all"))
    label = F.when(F.col("n") == 1, F.col("a").cast("string")).when(F.col("b") - F.col("a") + 1 == F.col("n"), F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string"))).otherwise(F.array_join(F.transform("all", lambda x: x.cast("string")), ","))
    return per.select("item", "panel", label.alias("label"), "n")
