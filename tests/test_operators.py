"""Relational operators: ranks, resume, joins, intervals, the judge stage, readers and writers."""

import json

import pytest
from pyspark.sql import functions as F

from quern.functions import scoring
from quern.operators import judge, rank, resolve, resume
from quern.plans import generate, intervals, moments, schema, steps
from quern.sources import jsonl, sinks


def test_global_rank_is_dense_and_total(spark):
    rows = spark.range(1000).select(F.col("id").alias("sample_id"), (F.col("id") % 7).cast("double").alias("overall"), F.lit("t").alias("task_name"))
    got = rank.top_fraction(rows, 0.25).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 1001))
    want = sorted(range(1000), key=lambda i: (-(i % 7), i))
    assert [r.sample_id for r in got] == want
    assert sum(r.accepted for r in got) == 250
    assert rank.keep_count(5) == 2 and rank.keep_count(1, 0.01) == 1 and rank.keep_count(0) == 0 and rank.keep_count(9, top_k=3) == 3


def test_copies_cancel_one_by_one(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b")], "pos int, fp string")
    done = spark.createDataFrame([("a",), ("a",), ("c",)], "fp string")
    assert sorted(r.pos for r in resume.pending_copies(rows, done, "fp", "pos").collect()) == [3, 4]


def test_step_number_and_match(spark):
    got = spark.createDataFrame([("prefix_step07.mp4",), ("x 12 y",), ("none",)], "t string").select(resolve.step_number(F.col("t")).alias("n")).collect()
    assert [r.n for r in got] == [7, 12, None]


def test_nearest_frame_ties_and_gaps(spark):
    frames = spark.createDataFrame([(1, 0.0), (2, 10.0), (3, 10.0), (4, 500.0)], "frame_index long, ts double")
    points = spark.createDataFrame([(1, 5.0), (2, 9.9), (3, 260.0), (4, -70.0), (5, 900.0)], "point_id long, t double")
    got = {r.point_id: r.frame_index for r in resolve.nearest(points, frames).collect()}
    assert got == {1: 1, 2: 2, 3: 4, 4: 1, 5: 4}


def test_nearest_frame_adds_each_row_once(spark):
    frames = spark.range(400).select(F.col("id").alias("frame_index"), (F.col("id") % 150 * 7).cast("double").alias("ts"))
    points = spark.range(900).select(F.col("id").alias("point_id"), F.when(F.col("id") % 10 == 0, None).when(F.col("id") % 3 == 0, 21.0).otherwise(F.col("id") * 1.3 - 40).alias("t"))
    got = resolve.nearest(points, frames)
    assert "unboundedfollowing" not in got._jdf.queryExecution().analyzed().toString().lower()
    first = {}
    for r in frames.collect():
        first[r.ts] = min(first.get(r.ts, r.frame_index), r.frame_index)
    want = {r.point_id: None if r.t is None else min((abs(x - r.t), i) for x, i in first.items()) for r in points.collect()}
    assert {r.point_id: None if r.gap is None else (r.gap, r.frame_index) for r in got.collect()} == want


def test_merge_tiny_head_middle_tail(spark):
    acts = spark.createDataFrame([(1, 1, 1, 1, 2), (1, 1, 2, 2, 8), (1, 1, 3, 8, 9), (1, 1, 4, 9, 20), (1, 1, 5, 20, 21)], "item long, step_id long, action_id int, start long, end long")
    got = intervals.merge_tiny(acts).orderBy("action_id").collect()
    assert [(r.action_id, r.start, r.end) for r in got] == [(1, 1, 8), (2, 8, 21)]
    alone = spark.createDataFrame([(1, 1, 1, 1, 2)], "item long, step_id long, action_id int, start long, end long")
    assert [(r.start, r.end) for r in intervals.merge_tiny(alone).collect()] == [(1, 2)]


def test_bad_plans_differ_in_one_place(spark):
    rows = spark.createDataFrame([(p, s, f"goal {p} {s}") for p in range(6) for s in range(1, 8)], "item long, step_id long, step_goal string")
    got = generate.bad_plans(rows, steps.goal_pool(rows)).collect()
    assert {r.flaw for r in got} == set(generate.FLAWS)
    for r in got:
        off = [i for i, (a, b) in enumerate(zip(r.bad_plan.split(" | "), r.repair.split(" | "))) if a != b]
        assert len(off) == (2 if r.flaw == "wrong_ordering" else 1) and off[0] == r.flaw_step - 1


def test_judge_sends_each_prompt_once_and_fails_closed(spark, tmp_path):
    rows = spark.createDataFrame([("a", []), ("a", []), ("b", ["missing_answer"]), ("c", [])], "q string, issues array<string>")
    log = tmp_path / "calls"

    def client():
        def call(prompt):
            with log.open("a") as f:
                f.write(prompt + "\n")
            if prompt == "c":
                raise judge.JudgeError("bad request", 400)
            return '{"visual_grounding_score": 80, "logical_coherence_score": 80, "visual_grounding_rationale": "x", "logical_coherence_rationale": "y"}'

        return call

    spec = judge.FilterSpec(F.col("q"), scoring.two_axis)
    got = judge.scored(judge.judged(rows, spec, client).cache(), spec).collect()
    assert sorted((r.q, r.score.overall) for r in got) == [("a", 80.0), ("a", 80.0), ("b", 0.0), ("c", 0.0)]
    assert sorted(log.read_text().split()) == ["a", "c"]


def test_retries_stop_on_request_errors():
    calls = []

    def call(prompt):
        calls.append(1)
        raise judge.JudgeError("busy", 503 if len(calls) < 3 else 404)

    got = judge.with_retries(call, "p", retries=5, wait=lambda s: None)
    assert got[0] is None and got[1].startswith("404") and len(calls) == 3


def test_lines_strict_and_lenient(spark, tmp_path):
    (tmp_path / "Task_01_A").mkdir()
    (tmp_path / "Task_01_A" / "data.jsonl").write_text('{"sample_id": "1"}\n\n[2]\nnot json\n')
    got = jsonl.read_lines(spark, str(tmp_path), strict=False)
    assert (got.count(), got.where("valid").count()) == (3, 1)
    assert [r.sample_id for r in jsonl.finished_ids(spark, str(tmp_path)).collect()] == ["1"]
    with pytest.raises(Exception, match="no JSON object"):
        jsonl.read_lines(spark, str(tmp_path)).collect()


def test_verdicts_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", "T1", True), ("b", "T1", False), ("c", "T2", True)], "sample_id string, task_name string, accepted boolean")
    sinks.write_verdicts(rows, f"{tmp_path}/out")
    back = spark.read.json(f"{tmp_path}/out")
    assert sorted((r.sample_id, r.verdict, r.task_name) for r in back.collect()) == [("a", "accepted", "T1"), ("b", "rejected", "T1"), ("c", "accepted", "T2")]
    with pytest.raises(ValueError):
        sinks.removable(spark.createDataFrame([("x",)], "item string"), spark.createDataFrame([], "item string"))


def test_lines_of_split_files_are_numbered(spark, tmp_path):
    from quern.sources import jsonl

    lines = [json.dumps({"i": i, "pad": "x" * (i % 40)}) for i in range(300)]
    (tmp_path / "a.jsonl").write_text("\n\n".join(lines) + "\n")
    (tmp_path / "b.jsonl").write_text("\n".join(lines[:5]))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = jsonl.numbered(jsonl.read_lines(spark, str(tmp_path))).select("source_file", "row_index", F.variant_get("row", "$.i", "int").alias("i")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 305 and all(r.row_index == r.i for r in rows)


def test_settings_prompts_and_summaries(spark, tmp_path):
    from quern.sources import benchmark, sinks

    path = str(tmp_path / "r.json")
    assert benchmark.read_registry(path) == {"models": {}}
    benchmark.write_json(path, {"models": {"m": {"model": "big", "reasoning_effort": "High", "max_output_tokens": 70}, "bad": {"max_output_tokens": 0}}})
    found = benchmark.read_registry(path)
    assert benchmark.model_settings("m", found) == benchmark.ModelSettings("m", "big", "high", 70)
    assert benchmark.model_settings("other", found, "none", None) == benchmark.ModelSettings("other", "other", None, 900)
    with pytest.raises(ValueError):
        benchmark.model_settings("bad", found)
    assert benchmark.prompt_errors({"a": "A", "b": "B"}, {"a": " ", "c": "问"}) == ["b: no prompt", "c: no title", "a: empty", "c: Han characters"]
    assert benchmark.merge_summary(path, {"done": 3})["done"] == 3 and "models" in benchmark.read_registry(path)
    sinks.write_lines(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first().value == '{"a":1,"b":null}'
    with pytest.raises(Exception, match="no_id"):
        lines = spark.sql("SELECT 'T' AS task_name, 0L AS row_index, parse_json('{}') AS row")
        benchmark.benchmark_items(lines, "qa").collect()


def test_plan_errors_read_each_plan_once(spark):
    texts = ['{}', '[]', '{"high_level_goal": null, "steps": {}}', '{"high_level_goal": "clip_3", "steps": []}', '{"high_level_goal": "a", "steps": [1, {"step_id": 2}, {"step_id": 2, "critical_frames": [{"frame_index": 9}, {"frame_index": 3}]}]}']
    rows = spark.createDataFrame([(7, t) for t in texts], "item long, t string")
    got = schema.plan_errors(rows.select("item", F.parse_json("t").alias("plan")))
    assert "Join" not in got._jdf.queryExecution().analyzed().toString()
    errors = {",".join(r.errors) for r in got.select(F.slice("errors", 1, 3).alias("errors")).collect()}
    step = "steps[0].step_id:not_int,steps[0].step_goal:missing,steps[0].rationale:missing"
    assert errors == {"top:missing_keys,top.high_level_goal:missing,top.steps:not_list", "top.high_level_goal:missing,top.steps:not_list", "top.high_level_goal:not_text,top.steps:not_list", "top.high_level_goal:leak", step}
    assert got.count() == 5
    whole = [r.errors for r in got.collect() if len(r.errors) > 20][0]
    assert "steps[2].critical_frames:decreasing" in whole and whole[-1] == "steps.step_id:duplicate"


def test_shared_points_are_worked_out_once(spark):
    ends = F.element_at(F.array(*[F.lit(y) for y in ("rests here", "can move", "is in frame_3", "stands far off")]), (F.col("id") % 4 + 1).cast("int"))
    said = {"sp_pre": ["The cup of glass", "A spoon beside it"], "af_pre": ["The handle may be held", "Its lid turns and"], "sp_eff": ["The cup of glass", "A spoon beside it"], "af_eff": ["No steam leaves as", "All heat"]}
    own = spark.range(40).select((F.col("id") % 4).alias("points_id"), F.lit("lift the cup").alias("step_goal"), (F.col("id") % 9).alias("item"), F.col("id").alias("step_id"), *[F.array(*[F.concat_ws(" ", F.lit(x), ends, F.lit(".")) for x in v]).alias(k) for k, v in said.items()])
    lines, points = own.select("item", "step_id", "points_id"), own.drop("item", "step_id").distinct()
    for family in (moments.conditions, moments.feasibility):
        alone = family(own)
        assert "Join" not in alone._jdf.queryExecution().analyzed().toString()  # a step's texts meet in its own row
        want = sorted(alone.collect())
        assert want and want == sorted(family(lines, points).collect())


def test_conditions_of_shared_points_are_not_broadcast(spark):
    # ten points say two things: texts are worked out for these, and neither they nor the points are sent to the driver whole
    texts = F.array(F.concat_ws(" ", F.lit("The cup is on"), F.when(F.col("id") % 2 == 0, "a table").otherwise("the shelf"), F.lit(".")), F.lit("A spoon lies beside it."))
    points = spark.range(10).select(F.col("id").alias("points_id"), *[texts.alias(c) for c in ("sp_pre", "af_pre", "sp_eff", "af_eff")])
    lines = spark.range(80).select((F.col("id") % 7).alias("item"), F.col("id").alias("step_id"), (F.col("id") % 12).alias("points_id"))
    got = moments.conditions(lines, points)
    plan = got._jdf.queryExecution()
    assert "Broadcast" not in plan.executedPlan().toString()
    assert plan.optimizedPlan().toString().count("frame_[0-9]+") == 2  # texts before and after, each tested for leaks once
    assert sorted(got.collect()) == sorted(moments.conditions(lines.join(points, "points_id")).collect())


def test_chains_of_shared_points_are_worked_out_once(spark):
    # twelve points say three things, two of which give one answer; an item meets it at several places
    cup = F.when(F.col("id") % 3 == 0, "The cup").when(F.col("id") % 3 == 1, "the cup").otherwise("The lid")
    say = lambda *ends: F.array(*[F.concat_ws(" ", cup, F.lit(e)) for e in ends])
    points = spark.range(12).select(F.col("id").alias("points_id"), (F.col("id") % 2 + 1).cast("int").alias("place"), F.lit("lift it").alias("step_goal"), F.lit("Grip holds it.").alias("mechanism"), say("is here.").alias("sp_pre"), say("may move.", "is not directly observable.").alias("af_pre"), say("is up.").alias("sp_eff"), say("is held.").alias("af_eff"))
    lines = spark.range(200).select((F.col("id") % 7).alias("item"), F.col("id").alias("step_id"), (F.col("id") % 13).alias("points_id"))
    got = moments.causal_chains(lines, points=points)
    plan = got._jdf.queryExecution()
    assert "Broadcast" not in plan.executedPlan().toString()
    assert "As a result" not in plan.optimizedPlan().toString()  # answers are there before lines are read
    want = sorted(moments.causal_chains(lines.join(points, "points_id")).collect())
    assert len(want) == 14 and want == sorted(got.collect())
