"""Evidence of question rows among files: clips, keyframes, manifests and step folders.

Files are an index (path); a pattern of names is matched by the parts that it leaves fixed, as join keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import let

IMAGE_KINDS = ["jpg", "jpeg", "png"]


def _two(step: Column) -> Column:
    return F.format_string("%02d", step.cast("int"))


def step_clip(rows: DataFrame, index: DataFrame, segments: DataFrame) -> DataFrame:
    """rows (row_id, folder, step) with the clip of their step (found) and the way it was found.

    1, 2: the segment from the step before (the start, for step 1) to this one, numbers padded or not;
    3: the clip that the step's segment (folder, step, clip_relpath) names; 4, 5: the first clip whose
    name begins with the step's number, padded or not. Steps below 1 have none.
    """
    r = rows.where("step >= 1").select("row_id", "folder", "step")
    name = lambda a, b: F.concat(F.col("folder"), F.lit("/last_frame_segments/segment_"), a, F.lit("_to_step"), b, F.lit(".mp4"))
    s = F.col("step")
    before = lambda form: F.when(s == 1, F.lit("start")).otherwise(F.concat(F.lit("step"), form(s - 1)))
    plain = lambda x: x.cast("string")
    exact = r.select("row_id", F.posexplode(F.array(name(before(_two), _two(s)), name(before(plain), plain(s)))).alias("p", "path")).select("row_id", (F.col("p") + 1).alias("way"), "path")
    named = r.join(segments.where(F.trim("clip_relpath") != ""), ["folder", "step"]).select("row_id", F.lit(3).alias("way"), F.concat("folder", F.lit("/stage2/"), F.trim("clip_relpath")).alias("path"))
    files = index.select("path").distinct()
    there = exact.unionByName(named).join(files, "path")
    parts = files.select("path", F.regexp_extract("path", r"^(.*)/stage2/step_clips/step([0-9]+)_[^/]*\.mp4$", 1).alias("folder"), F.regexp_extract("path", r"/step([0-9]+)_[^/]*\.mp4$", 1).alias("digits")).where("folder <> ''")
    keys = r.select("row_id", "folder", F.posexplode(F.array(_two(s), plain(s))).alias("p", "digits"))
    like = keys.join(parts, ["folder", "digits"]).select("row_id", (F.col("p") + 4).alias("way"), "path")
    best = there.select("row_id", "way", "path").unionByName(like).groupBy("row_id").agg(F.min(F.struct("way", "path")).alias("b"))
    return rows.join(best, "row_id", "left").select(*rows.columns, F.col("b.path").alias("found"), F.col("b.way").alias("way"))


def keyframe_image(rows: DataFrame, index: DataFrame) -> DataFrame:
    """rows (row_id, folder, step, frame) with the image of their frame (found).

    Step folders stand in the item's folder, then in its stage3; jpg comes before jpeg and png, names
    with a time before others, then the first by name.
    """
    at = lambda k: F.regexp_extract("path", r"^(.*)/([0-9]+)_[^/]*/frame_([0-9]+)_(ts_)?[^/]*\.(jpg|jpeg|png)$", k)
    images = index.select("path").distinct().select("path", at(1).alias("base"), at(2).alias("s"), at(3).alias("f"), (at(4) == "").alias("untimed"), F.array_position(F.array(*[F.lit(k) for k in IMAGE_KINDS]), at(5)).alias("kind")).where("base <> ''")
    keys = rows.select("row_id", F.posexplode(F.array(F.col("folder"), F.concat("folder", F.lit("/stage3")))).alias("place", "base"), _two(F.col("step")).alias("s"), F.format_string("%03d", F.col("frame").cast("int")).alias("f"))
    best = keys.join(images, ["base", "s", "f"]).groupBy("row_id").agg(F.min(F.struct("place", "kind", "untimed", "path")).alias("b"))
    return rows.join(best, "row_id", "left").select(*rows.columns, F.col("b.path").alias("found"))


def _slug(goal: Column) -> Column:
    return F.regexp_replace(F.trim(F.translate(F.lower(goal), "'\",", "")), r"\s+", "_")


def built_clip(folder: Column, step: Column, goal: Column) -> Column:
    """Where the clip of a step should be."""
    return F.concat(folder, F.lit("/stage2/step_clips/step"), _two(step), F.when(F.coalesce(goal, F.lit("")) != "", F.concat(F.lit("_"), _slug(goal))).otherwise(F.lit("")), F.lit(".mp4"))


def built_prefix(folder: Column, step: Column) -> Column:
    return F.concat(folder, F.lit("/cumulative_last_frame_segments/segment_start_to_step"), _two(step), F.lit("_last.mp4"))


def built_keyframe(folder: Column, step: Column, frame: Column, goal: Column, time: Column) -> Column:
    """Where a keyframe's image should be; time may be empty."""
    where = F.concat(_two(step), F.lit("_"), F.when(F.coalesce(goal, F.lit("")) != "", _slug(goal)).otherwise(F.lit("unknown")))
    stamp = F.when(F.coalesce(time, F.lit("")) != "", F.concat(F.lit("_ts_"), time)).otherwise(F.lit(""))
    return F.concat(folder, F.lit("/stage3/"), where, F.lit("/frame_"), F.format_string("%03d", frame.cast("int")), stamp, F.lit(".jpg"))


def manifest_images(spans: DataFrame, manifest: DataFrame) -> DataFrame:
    """spans (item, step_id, start, end) with the manifest's (item, frame_index, image_relpath) images of both frames."""
    image = lambda c: manifest.select("item", F.col("frame_index").alias(c), F.col("image_relpath").alias(f"{c}_image"))
    return spans.join(image("start"), ["item", "start"], "left").join(image("end"), ["item", "end"], "left").select(*spans.columns, "start_image", "end_image")


def clip_start(rows: DataFrame, metas: DataFrame, segments: DataFrame, manifests: DataFrame) -> DataFrame:
    """rows (row_id, item, step) with start_sec of their clip, and the way: 1 the first step folder's note
    (item, step, step_dir, clip_start_sec), 2 the step's segment (item, step, start_sec), 3 the least time
    of the first manifest (item, step, step_dir, ts). Texts that are no numbers do not count."""
    number = lambda c: F.col(c).cast("string").try_cast("double")
    a = metas.withColumn("x", number("clip_start_sec")).where("x is not null").groupBy("item", "step").agg(F.min_by("x", "step_dir").alias("a"))
    b = segments.withColumn("x", number("start_sec")).where("x is not null").groupBy("item", "step").agg(F.min("x").alias("b"))
    times = manifests.withColumn("x", number("ts")).where("x is not null").groupBy("item", "step", "step_dir").agg(F.min("x").alias("x"))
    c = times.groupBy("item", "step").agg(F.min_by("x", "step_dir").alias("c"))
    out = rows.join(a, ["item", "step"], "left").join(b, ["item", "step"], "left").join(c, ["item", "step"], "left")
    way = F.when(F.col("a").isNotNull(), 1).when(F.col("b").isNotNull(), 2).when(F.col("c").isNotNull(), 3)
    return out.select(*rows.columns, F.coalesce("a", "b", "c").alias("start_sec"), way.alias("way"))


def step_folder(rows: DataFrame, folders: DataFrame, slack: float = 1e-3) -> DataFrame:
    """rows (row_id, item, step, goal, clip, start_sec, end_sec) with the folder to work in.

    Of the step's folders (item, step, step_dir, clip, start_sec, end_sec) the first whose clip is the
    same and whose times are within `slack`; else the first; else a new one named by step and goal.
    """
    f = folders.select("item", "step", "step_dir", F.col("clip").alias("c"), F.col("start_sec").alias("a"), F.col("end_sec").alias("b"))
    fits = F.coalesce((F.col("c") == F.col("clip")) & (F.abs(F.col("a") - F.col("start_sec")) <= slack) & (F.abs(F.col("b") - F.col("end_sec")) <= slack), F.lit(False))
    best = rows.join(f, ["item", "step"]).groupBy("row_id").agg(F.min(F.struct((~fits).alias("n"), "step_dir")).alias("x"))
    out = rows.join(best, "row_id", "left")
    new = F.concat(_two(F.col("step")), F.lit("_"), _slug(F.col("goal")))
    return out.select(*rows.columns, F.coalesce(F.col("x.step_dir"), new).alias("step_dir"), F.when(F.col("x").isNull(), "new").when(F.col("x.n"), "other").otherwise("same").alias("state"))


def keyframe_pairs(pairs: DataFrame, frames: DataFrame) -> DataFrame:
    """pairs (item, first, second) with whether their images (item, frame_index, digest) are the same, and if so
    the item's first and last frames among those that repeat no earlier one."""
    digest = lambda c: frames.select("item", F.col("frame_index").alias(c), F.col("digest").alias(f"{c}_digest"))
    unique = frames.groupBy("item", "digest").agg(F.min("frame_index").alias("i")).groupBy("item").agg(F.min("i").alias("low"), F.max("i").alias("high"))
    out = pairs.join(digest("first"), ["item", "first"], "left").join(digest("second"), ["item", "second"], "left").join(unique, "item", "left")
    same = F.coalesce(F.col("first_digest") == F.col("second_digest"), F.lit(False))
    fixed = same & (F.col("low") < F.col("high"))
    return out.select("item", same.alias("identical"), F.when(fixed, F.col("low")).otherwise(F.col("first")).alias("first"), F.when(fixed, F.col("high")).otherwise(F.col("second")).alias("second"))


def action_times(actions: DataFrame, frames: DataFrame, clips: DataFrame, least: float = 0.04) -> DataFrame:
    """actions (item, step_id, action_id, start, end) with their times in the source and in the clip.

    frames: (item, step_id, place from 1, ts); clips: (item, step_id, clip_start, clip_end). An end after
    the last frame is the clip's end or the last time, whichever is first. In the clip, times are kept
    inside it, and spans shorter than `least` are widened, to the left at the clip's end.
    """
    time = lambda c, n: frames.select("item", "step_id", F.col("place").alias(c), F.col("ts").alias(n))
    last = frames.groupBy("item", "step_id").agg(F.max("ts").alias("last_ts"))
    out = actions.join(clips, ["item", "step_id"]).join(last, ["item", "step_id"]).join(time("start", "start_sec"), ["item", "step_id", "start"]).join(time("end", "e"), ["item", "step_id", "end"], "left")
    long_ = F.col("clip_end") - F.col("clip_start")
    inside = lambda c: F.greatest(F.lit(0.0), F.least(c - F.col("clip_start"), long_))
    out = out.withColumns({"a": inside(F.col("start_sec")), "b": F.when(F.col("e").isNotNull(), inside(F.col("e"))).otherwise(long_)})
    short = F.col("b") - F.col("a") < least
    end = F.when(short, F.least(F.col("a") + least, long_)).otherwise(F.col("b"))
    start = F.when(short & (end - F.col("a") < least), F.greatest(F.lit(0.0), end - least)).otherwise(F.col("a"))
    return out.select(*actions.columns, "start_sec", F.coalesce("e", F.least("clip_end", "last_ts")).alias("end_sec"), start.alias("local_start"), end.alias("local_end"))


def plan_step(rows: DataFrame, steps: DataFrame) -> DataFrame:
    """rows (row_id, item, goal, evidence_step) with their plan's step: by goal (the first such), else by the evidence's step id."""
    key = F.trim(F.lower("step_goal"))
    goals = steps.groupBy("item", key.alias("k")).agg(F.min("step_id").alias("by_goal"))
    ids = steps.select("item", F.col("step_id").alias("evidence_step"), F.col("step_id").alias("by_id"))
    out = rows.withColumn("k", F.trim(F.lower("goal"))).join(goals, ["item", "k"], "left").join(ids, ["item", "evidence_step"], "left")
    return out.select(*rows.columns, F.coalesce("by_goal", "by_id").alias("step_id"), F.when(F.col("by_goal").isNotNull(), "goal").when(F.col("by_id").isNotNull(), "evidence").otherwise("none").alias("by"))


def keyframe_of(rows: DataFrame, frames: DataFrame, prefix: int = 50) -> DataFrame:
    """rows (row_id, item, goal, patient, mechanism, answer) with a keyframe (item, place, goal, patient, mechanism, description).

    1: equal goal, patient and mechanism; 2: equal goal, and the beginning of the description stands in
    the answer; 3: the item's first keyframe.
    """
    f = frames.select("item", "place", *[F.col(c).alias(f"_{c}") for c in ("goal", "patient", "mechanism", "description")])
    same = lambda c: F.col(c) == F.col(f"_{c}")
    begin = F.lower(F.substring("_description", 1, prefix))
    way = F.when(same("goal") & same("patient") & same("mechanism"), 1).when(same("goal") & (begin != "") & F.contains(F.lower("answer"), begin), 2).otherwise(3)
    best = rows.join(f, "item").groupBy("row_id").agg(F.min(F.struct(way.alias("way"), "place")).alias("b"))
    return rows.join(best, "row_id", "left").select(*rows.columns, F.col("b.place").alias("place"), F.col("b.way").alias("way"))


def preferred(frames: Column, index: int) -> Column:
    """The keyframe at a place from 0, the first if there is none; null without any."""
    return F.coalesce(F.get(frames, F.lit(index)), F.get(frames, F.lit(0)))


def media_path(path: Column, root: str | None = None, mode: str = "as_is") -> Column:
    """A media path as it is, absolute, or relative to the root; links and data stay. Dots in paths are resolved when they are made absolute."""
    full = F.when(F.startswith(path, F.lit("/")) | F.lit(root is None), path).otherwise(F.concat(F.lit((root or "").rstrip("/") + "/"), path))

    def resolved(p: Column) -> Column:
        keep = F.filter(F.split(p, "/"), lambda x: ~x.isin("", "."))
        up = lambda a, x: F.when(x == "..", F.slice(a, F.lit(1), F.greatest(F.lit(0), F.size(a) - 1))).otherwise(F.concat(a, F.array(x)))
        return F.concat(F.lit("/"), F.array_join(F.aggregate(keep, F.array().cast("array<string>"), up), "/"))

    def made(p: Column) -> Column:
        if mode == "absolute":
            return resolved(p)
        if mode == "relative" and root is not None:
            head = root.rstrip("/") + "/"
            return let(resolved(p), lambda r: F.when(F.startswith(r, F.lit(head)), F.substring(r, F.lit(len(head) + 1), F.length(r))).otherwise(p))
        return p

    return F.when(path.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://") | F.startswith(path, F.lit("data:")), path).otherwise(let(full, made))


def manifest_text(frames: DataFrame) -> DataFrame:
    """(item, manifest): a line 'index: time s' for each frame (item, frame_index, ts), in order."""
    line = lambda x: F.concat(x["frame_index"].cast("string"), F.lit(": "), x["ts"].cast("decimal(18,2)").cast("string"), F.lit(" s"))
    rows = frames.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("frame_index", "ts"))).alias("f"))
    return rows.select("item", F.array_join(F.transform("f", line), "\n").alias("manifest"))


def steps_of_file(name: Column, whole_prefix: Column) -> Column:
    """Step numbers of a clip's name: the one it has, or with `whole_prefix` all from 1 to it; empty without one."""
    n = F.regexp_extract(F.element_at(F.split(name, "/"), -1), r"step([0-9]+)", 1).try_cast("int")
    return F.when(F.coalesce(n, F.lit(0)) < 1, F.array().cast("array<int>")).when(whole_prefix, F.sequence(F.lit(1), n)).otherwise(F.array(n))


def in_step_order(steps: Column) -> Column:
    """Steps (array of structs with a text step_id) by number; those without a number come first, as 0."""
    keyed = F.transform(steps, lambda s, i: F.struct(F.coalesce(s["step_id"].try_cast("int"), F.lit(0)).alias("k"), i.alias("i"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda x: x["s"])
