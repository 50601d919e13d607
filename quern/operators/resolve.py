"""Lookup joins between question rows, plans, files and frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import ngrams, overlap_coefficient, sentences, share, terms, words
from quern.session import settle


def step_number(text: Column) -> Column:
    """The number after 'step', 'prefix' or 'atomic_step', else the first number on its own."""
    named = F.nullif(F.regexp_extract(text, r"(?i)(?:step|prefix|atomic[_-]?step)[^0-9]*([0-9]+)", 1), F.lit(""))
    return F.coalesce(named, F.nullif(F.regexp_extract(text, r"\b([0-9]+)\b", 1), F.lit(""))).try_cast("int")


def match_step(rows: DataFrame, steps: DataFrame) -> DataFrame:
    """rows (row_id, item, step_index) with the matching step (item, pos from 0, step_id, step_goal) of their plan.

    A step whose id is the index wins, then the step at that position, then the one before it.
    """
    keys = steps.select(
        "item", "pos", F.struct("step_id", "step_goal").alias("step"),
        F.explode(F.array(F.struct(F.lit(1).alias("p"), F.col("step_id").alias("k")), F.struct(F.lit(2).alias("p"), F.col("pos").alias("k")), F.struct(F.lit(3).alias("p"), (F.col("pos") + 1).alias("k")))).alias("x"),
    )
    found = rows.join(keys.select("item", F.col("x.k").alias("step_index"), "x.p", "pos", "step"), ["item", "step_index"])
    best = found.groupBy("row_id").agg(F.min_by("step", F.struct("p", "pos")).alias("step"))
    return rows.join(best, "row_id", "left").select(*rows.columns, F.col("step.step_id").alias("matched_step_id"), F.col("step.step_goal").alias("matched_goal"))


def goal_lookup(steps: DataFrame) -> DataFrame:
    """(item, goal_key, step_id): the last step of each goal, quotes folded and blanks collapsed."""
    return steps.groupBy("item", folded_goal(F.col("step_goal")).alias("goal_key")).agg(F.max_by("step_id", "pos").alias("step_id"))


def folded_goal(goal: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(F.lower(goal), "‘’“”", "''\"\""), r"\s+", " "))


def theta_goal(rows: DataFrame, steps: DataFrame, length: int = 60) -> DataFrame:
    """rows (row_id, item, wanted, wanted_id) with a step: by exact id, else the first whose goal holds the
    beginning of the wanted text, else the plan's first step. Only steps of the row's own plan are looked at."""
    pair = rows.join(steps.select("item", "pos", "step_id", "step_goal"), "item", "left")
    begin = F.lower(F.substring(F.trim("wanted"), 1, length))
    way = F.when(F.col("step_id") == F.col("wanted_id"), 1).when((begin != "") & F.contains(F.lower("step_goal"), begin), 2).otherwise(3)
    best = pair.groupBy("row_id").agg(F.min_by(F.struct("step_id", "step_goal", way.alias("way")), F.struct(way, F.col("pos"))).alias("s"))
    return rows.join(best, "row_id", "left").select(*rows.columns, "s.step_id", "s.step_goal", "s.way")


def first_file(rows: DataFrame, index: DataFrame, candidates: str = "candidates") -> DataFrame:
    """rows (row_id, candidates array) with the first candidate that the path index (path) has."""
    each = rows.select("row_id", F.posexplode(candidates).alias("place", "path"))
    found = each.join(index.select("path").distinct(), "path").groupBy("row_id").agg(F.min_by("path", "place").alias("found"), F.min("place").alias("place"))
    return rows.join(found, "row_id", "left")


def prefix_candidates(folder: Column, step: Column, source: Column) -> Column:
    """Where the clip of the first steps may be, in order; the whole video last."""
    two = F.lpad(step.cast("string"), 2, "0")
    names = [
        F.concat(folder, F.lit("/prefix_clips/prefix_step"), two, F.lit(".mp4")),
        F.concat(folder, F.lit("/prefix_clips/prefix_step"), step.cast("string"), F.lit(".mp4")),
        F.concat(folder, F.lit("/cumulative_last_frame_segments/segment_start_to_step"), two, F.lit(".mp4")),
        F.concat(folder, F.lit("/cumulative_last_frame_segments/segment_start_to_step"), step.cast("string"), F.lit(".mp4")),
    ]
    return F.array(*names, source)


def nearest(points: DataFrame, frames: DataFrame) -> DataFrame:
    """points (point_id, t) with the frame (frame_index, ts) nearest in time and the gap; the smaller index on ties.

    Both sides are range-partitioned by time together (equal times by their points as well). In its
    partition a point finds the last frame at or before it and the first at or after it; beyond the
    partition's ends it takes the next partition's that has a frame (one row for each partition). No
    point meets more than two frames. Both windows run from an end to the current row, so that each
    row is added once: a frame from the current row to the end is worked out anew for every row.
    Points without a time, or without any frame, get nulls.
    """
    one = frames.where("ts is not null").groupBy(F.col("ts").cast("double").alias("x")).agg(F.min("frame_index").alias("frame"))
    f = one.select("x", F.struct("x", "frame").alias("f"), F.lit(None).cast(points.schema).alias("p"))
    p = points.select(F.col("t").cast("double").alias("x"), F.lit(None).cast(f.schema["f"].dataType).alias("f"), F.struct(*points.columns).alias("p"))
    dealt = settle(f.unionByName(p).repartitionByRange(F.col("x"), F.xxhash64("p.point_id")).withColumn("part", F.spark_partition_id()))
    so_far = lambda *order: Window.partitionBy("part").orderBy(*order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    local = dealt.withColumns({"before": F.last("f", True).over(so_far("x")), "after": F.last("f", True).over(so_far(F.desc("x")))}).where("p is not null")
    ends = dealt.groupBy("part").agg(F.min("f").alias("low"), F.max("f").alias("high"))
    past = lambda order: Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)  # noqa: E731  one row for each partition
    ends = ends.select("part", F.last("high", True).over(past(F.asc("part"))).alias("left"), F.last("low", True).over(past(F.desc("part"))).alias("right"))
    side = lambda c: F.when(c.isNotNull() & F.col("x").isNotNull(), F.struct(F.abs(c["x"] - F.col("x")).alias("gap"), c["frame"].alias("frame")))
    best = F.array_min(F.array_compact(F.array(side(F.coalesce("before", "left")), side(F.coalesce("after", "right")))))
    out = local.join(F.broadcast(ends), "part").withColumn("best", best)
    return out.select(*[F.col("p")[c].alias(c) for c in points.columns], F.col("best.frame").alias("frame_index"), F.col("best.gap").alias("gap"))


def overlapping_rows(a: DataFrame, b: DataFrame, keys: list[str], most: float = 0.75) -> DataFrame:
    """Rows of a without those whose answer shares over `most` of its terms with a row of b of the same keys."""
    pair = a.alias("a").join(b.select(*keys, F.col("answer").alias("_other")), keys)
    hit = pair.where(overlap_coefficient(terms(F.col("answer")), terms(F.col("_other"))) > most).select("row_id").distinct()
    return a.join(hit, "row_id", "left_anti")


def sentence_repetition(texts: DataFrame, key: str, column: str, threshold: float = 0.3) -> DataFrame:
    """(key, repetition): share of a text's sentence pairs, at least two apart, whose word trigrams have a Jaccard index over the threshold.

    Only sentences that share a trigram meet; the number of pairs is counted, not made. Texts of
    fewer than four sentences, or without such pairs, have 0; a null text too.
    """
    each = texts.select(key, sentences(F.col(column), 15).alias("s")).where(F.size("s") >= 4).select(key, F.posexplode("s").alias("pos", "s"))
    grams = settle(each.select(key, "pos", ngrams(words(F.lower("s")), 3).alias("g")).where(F.size("g") > 0))
    beside = F.lag("pos").over(Window.partitionBy(key).orderBy("pos")) == F.col("pos") - 1
    n = F.count(F.lit(1))
    pairs = grams.withColumn("beside", beside).groupBy(key).agg((n * (n - 1) / 2 - F.count_if("beside")).alias("pairs"))
    one = grams.select(key, "pos", F.size("g").alias("n"), F.explode("g").alias("g"))
    a, b = one.alias("a"), one.alias("b")
    met = a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.g") == F.col("b.g")) & (F.col("b.pos") >= F.col("a.pos") + 2))
    same = met.groupBy(F.col(f"a.{key}").alias(key), "a.pos", "b.pos", "a.n", "b.n").agg(n.alias("same")).toDF(key, "i", "j", "m", "n", "same")
    hits = same.where(F.col("same") / (F.col("m") + F.col("n") - F.col("same")) > threshold).groupBy(key).agg(n.alias("hits"))
    rates = pairs.join(hits, key, "left").select(key, share(F.coalesce("hits", F.lit(0)), F.col("pairs")).alias("repetition"))
    return texts.select(key).join(rates, key, "left").select(key, F.coalesce("repetition", F.lit(0.0)).alias("repetition"))


def longest_names(names: DataFrame, group: str, name: str) -> DataFrame:
    """Distinct names (group, name) that do not stand, word by word, inside a longer one of their group.

    Each name gives the runs of its words that are shorter than itself; names among these go.
    """
    own = names.select(group, name).where(F.col(name).isNotNull()).distinct()
    parts = F.split(name, " ")
    n = F.size(parts)
    at = lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.array_join(F.slice(parts, i, k), " "))
    runs = own.select(group, F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), n), at)))).alias("run"), name).where(F.col("run") != F.col(name))
    return own.join(runs.select(group, F.col("run").alias(name)).distinct(), [group, name], "left_anti")


def compared_ids(draft: DataFrame, found: DataFrame) -> DataFrame:
    """(item, step_id, status): both, missing (only drafted), unexpected (only found), duplicate (found twice)."""
    seen = found.groupBy("item", "step_id").agg(F.count(F.lit(1)).alias("n"))
    out = draft.select("item", "step_id", F.lit(1).alias("d")).join(seen, ["item", "step_id"], "full_outer")
    return out.select("item", "step_id", F.when(F.col("n").isNull(), "missing").when(F.col("d").isNull(), "unexpected").when(F.col("n") > 1, "duplicate").otherwise("both").alias("status"))


def merged_plan(refined: DataFrame, actions: DataFrame) -> DataFrame:
    """Steps (item, step_id, ...) with their atomic actions as an ordered array, empty if they have none."""
    own = actions.groupBy("item", "step_id").agg(F.array_sort(F.collect_list(F.struct("atomic_action_id", "action"))).alias("atomic_actions"))
    return refined.join(own, ["item", "step_id"], "left").withColumn("n_actions", F.coalesce(F.size("atomic_actions"), F.lit(0)))


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def name_pattern(pattern: Column) -> Column:
    """The last part of a pattern with * and ? as a regular expression."""
    name = F.regexp_replace(F.element_at(F.split(pattern, "/"), -1), r"([\\.^$|+(){}\[\]])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(F.replace(name, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))


def first_matching(rows: DataFrame, index: DataFrame, patterns: str = "patterns") -> DataFrame:
    """rows (row_id, patterns array) with the first file by name of the first pattern that has one; only names have wildcards.

    Files (path) meet patterns of their own folder.
    """
    files = index.select("path").distinct().select("path", folder_of(F.col("path")).alias("folder"), F.element_at(F.split("path", "/"), -1).alias("name"))
    each = rows.select("row_id", F.posexplode(patterns).alias("place", "p")).select("row_id", "place", folder_of(F.col("p")).alias("folder"), name_pattern(F.col("p")).alias("like"))
    best = each.join(files, "folder").where(F.expr("name rlike like")).groupBy("row_id").agg(F.min(F.struct("place", "path")).alias("b"))
    return rows.join(best, "row_id", "left").select(*rows.columns, F.col("b.path").alias("found"))


def plan_files(index: DataFrame, name: str = "final_plan.json") -> DataFrame:
    """(item, path) of plan files; a folder below another with a plan is not looked into."""
    plans = index.select("path").distinct().where(F.endswith("path", F.lit("/" + name))).select("path", folder_of(F.col("path")).alias("item"))
    parts = F.split("item", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    below = plans.select("path", F.explode(F.when(F.size(parts) > 1, above)).alias("item")).join(plans.select("item"), "item", "left_semi")
    return plans.join(below.select("path").distinct(), "path", "left_anti").select("item", "path")


def loaded_plans(items: DataFrame, texts: DataFrame) -> DataFrame:
    """items (item) with their plan (item, text) as a VARIANT; null if it is missing or no JSON object."""
    plan = F.try_parse_json("text")
    own = texts.select("item", F.when(F.startswith(F.schema_of_variant(plan), F.lit("OBJECT")), plan).alias("plan"))
    return items.join(own, "item", "left")


def placed_media(rows: DataFrame, files: DataFrame, bases: list[str]) -> DataFrame:
    """rows (row_id, media) with the file (path, size) that the path names, as it is or under the first base that has it, if it is not empty."""
    tries = F.array(F.col("media"), *[F.concat(F.lit(b.rstrip("/") + "/"), F.col("media")) for b in bases])
    there = files.where("size > 0").select("path")
    return first_file(rows.withColumn("candidates", tries), there).drop("candidates", "place")


def repaired_quotes(rewrite: Column, draft: Column) -> Column:
    """A rewrite whose quoted parts are the draft's, place by place, if both have as many; else as it is."""
    a, b = F.split(rewrite, '"', -1), F.split(draft, '"', -1)
    inner = F.transform(F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda z, i: F.when(i % 2 == 1, z["y"]).otherwise(z["x"]))
    fits = (F.size(a) == F.size(b)) & (F.size(a) % 2 == 1)
    return F.when(fits, F.array_join(inner, '"')).otherwise(rewrite)
