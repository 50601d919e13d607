"""Expressions on small fixed inputs, with values worked out by hand or in plain Python."""

import pytest
from pyspark.sql import functions as F

from quern.functions import json, leak, scoring, text
from quern.operators import evaluate, qa


def one(spark, column, **inputs):
    frame = spark.range(1).select(*[F.lit(v).alias(k) for k, v in inputs.items()] or [F.lit(1).alias("_")])
    return frame.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "raw, overall, tags",
    [
        ('{"visual_grounding_score": 90, "logical_coherence_score": 40, "visual_grounding_rationale": "a", "logical_coherence_rationale": "b"}', 60.0, ["none"]),
        ('{"visual_grounding_score": 90, "logical_coherence_score": 40, "visual_grounding_rationale": "a", "logical_coherence_rationale": "b", "major_failure_tags": ["Wrong_Step"]}', 34.0, ["wrong_step"]),
        ('x {"visual_grounding_score": "88", "logical_coherence_score": 140, "visual_grounding_rationale": "a", "logical_coherence_rationale": " ", "failure_tags": "n/a"} y', 60.0, ["none"]),
        ('{"visual_grounding_score": true, "logical_coherence_score": 40}', 0.0, ["parse_error"]),
        ("[1]", 0.0, ["parse_error"]),
        ("", 0.0, ["parse_error"]),
        (None, 0.0, ["parse_error"]),
    ],
)
def test_two_axis(spark, raw, overall, tags):
    got = spark.createDataFrame([(raw,)], "raw string").select(scoring.two_axis(F.col("raw")).alias("s")).first().s
    assert (got.overall, got.tags) == (overall, tags)


def test_five_axis_low_axis_and_effect(spark):
    axes = ", ".join(f'"{k}": {v}' for k, v in zip(scoring.FIVE_AXES, (80, 80, 80, 80, 45)))
    notes = ", ".join(f'"{k}": "so"' for k in scoring.FIVE_AXES.values())
    got = one(spark, scoring.five_axis(F.lit(f"{{{axes}, {notes}}}")))
    assert got.overall == 60.0
    got = one(spark, scoring.five_axis(F.lit(f'{{{axes}, {notes}, "hallucinated_effects": ["x"]}}')))
    assert (got.overall, got.tags) == (24.0, ["hallucinated_effect"])


@pytest.mark.parametrize(
    "response, letter",
    [('{"answer": "b"}', "B"), ("```json\n{\"answer\": \"C\"}\n```", "C"), ("Final answer: C", "C"), ("I choose option b", "B"), ("so </think> D", "D"), ("A", "A"), ("it is (C) or so", "C"), ("", None), ("zzz", None)],
)
def test_letter(spark, response, letter):
    assert one(spark, evaluate.mcq_letter(F.lit(response))) == letter


def test_token_metrics(spark):
    got = one(spark, text.reward_tokens(F.lit("The re-lower of it's a Lid, x")))
    assert sorted(got) == ["it's", "lid", "re-lower"]
    a, b = F.array(F.lit("p"), F.lit("q")), F.array(F.lit("q"), F.lit("r"))
    assert one(spark, text.token_f1(a, b)) == 0.5
    assert one(spark, text.jaccard(a, b)) == pytest.approx(1 / 3)


def test_ngrams_and_repetition(spark):
    assert one(spark, text.ngrams(text.words(F.lit("a b a b a")), 2)) == ["a b", "b a"]
    assert one(spark, text.novelty(F.lit("a b c d e"), F.lit("x a b c d"))) == 0.5
    assert one(spark, text.novelty(F.lit("a b"), F.lit(""))) == 0.0
    assert one(spark, text.half_repetition(F.lit(" ".join(["w x y z"] * 10)))) == 1.0


def test_text_helpers(spark):
    assert one(spark, text.numbered_points(F.lit("1. one\\n- two\n\n3) three"))) == ["one", "two", "three"]
    assert one(spark, text.ended(F.lit("so it is !"))) == "so it is!"
    assert one(spark, text.stripped_headings(F.lit("FINAL ANSWER: yes\n\n\n\nno"))) == "yes\n\nno"
    assert one(spark, text.shortened_goal(F.lit("open the lid, then close it"))) == "open the lid"
    assert one(spark, text.same_root(F.lit("stabilize"), F.lit("stabilizing")))
    assert not one(spark, text.same_root(F.lit("open"), F.lit("operate")))
    assert one(spark, text.uniform_index(F.lit(6), F.lit(3))) == [0, 2, 5]
    assert one(spark, text.keep_first(F.array(F.lit("a b c d e"), F.lit("a b c d e f"), F.lit("x y")))) == ["a b c d e", "x y"]


def test_leaks(spark):
    for t, want in (("see frame_12", True), ("at 12:30", True), ("clip.MP4 here", True), ("/a/b/c", True), ("the frame of a door", False), ("", False)):
        assert one(spark, leak.has_leak(F.lit(t))) is want
    assert one(spark, leak.is_placeholder(F.lit(" N/A ")))


def test_json_object(spark):
    v = json.object_of(F.lit('pre {"a": {"b": 1}, "t": ["x", " ", "y"]} post'))
    assert one(spark, json.texts_at(v, "none", "t")) == ["x", "y"]
    assert one(spark, json.object_of(F.lit("{bad")).isNull())


def test_rubric_caps_and_errors(spark):
    pairs = lambda name, value: F.create_map(*[F.lit(x) for i in range(1, 6) for x in (f"{name}{i}", value)])
    args = lambda a, d, e: scoring.rubric_score(F.lit("Task_01"), a, d, e, F.lit(True))
    ok = one(spark, args(pairs("q", "yes"), pairs("d", "No"), pairs("q", "seen")))
    assert (ok.score, ok.status) == (1.0, "ok")
    capped = one(spark, args(pairs("q", "yes"), pairs("d", "Yes"), pairs("q", "seen")))
    assert capped.score == 0.25
    assert one(spark, args(pairs("q", "maybe"), pairs("d", "No"), pairs("q", "x"))).status == "invalid_answer_choice"
    assert one(spark, args(pairs("z", "yes"), pairs("d", "No"), pairs("q", "x"))).status == "missing_answers"


def test_recovery_parrot_is_capped(spark):
    got = one(spark, scoring.recovery_reward(F.lit("the cup slipped from hand"), F.lit("cup slipped hand"), F.lit("wipe table dry"), F.lit("pour water")))
    assert got <= 0.30
    assert one(spark, scoring.blended(F.lit("Task_18"), F.lit(0.4), F.lit(0.8))) == pytest.approx(0.7)
    assert one(spark, scoring.blended(F.lit("Task_18"), F.lit(0.4), F.lit(-1.0))) == -1.0


def test_sample_normalisation(spark):
    raw = '{"prompt": " ", "query": "why?", "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a1"}, {"from": "gpt", "value": "a2"}], "video": ["a.mp4", "b.mp4"], "meta": {"id": "m1", "llm_fields": {"action": "lift", "effect": ""}}}'
    lines = spark.createDataFrame([("f/Task_07_X/data.jsonl", 3, raw)], "source_file string, row_index long, raw string").withColumn("row", F.try_parse_json("raw"))
    r = qa.normalised(lines).first()
    assert (r.task_name, r.sample_id, r.question, r.answer, r.evidence_type, r.videos) == ("Task_07_X", "m1", "why?", "a2", "video_clip_pair", ["a.mp4", "b.mp4"])
    assert r.fields == {"action": '"lift"'}


def test_word_forms(spark):
    from quern.functions import morph

    for given, want in (("lift the lid", "lifting the lid"), ("Close it", "Closing it"), ("cut and open the bag, then pour", "cutting and opening the bag, then pouring"), ("bring tea", "bringing tea"), ("seeing", "seeing"), ("the cup", "the cup"), ("", "")):
        assert one(spark, morph.progressive(F.lit(given))) == want
    names = spark.createDataFrame([("Café au-lait 2",), ("2 cups",), (None,), ("!!",)], "t string").select(morph.ascii_name(F.col("t")).alias("n")).collect()
    assert [r.n for r in names] == ["cafe_au_lait_2", "obj_2_cups", None, ""]
    assert one(spark, morph.relation_sentence(F.lit("contacting"), F.array(F.lit("cup"), F.lit("lid"), F.lit("table")), F.lit(False))) == "The cup is not in contact with the lid and table."
    assert one(spark, morph.listing(F.array(F.lit("a"), F.lit("b"), F.lit("c")))) == "a, b, and c"
    assert one(spark, morph.counterfactual_clause(F.lit("What if the cup slips?"))) == "the cup slips"
    assert one(spark, morph.cleaned_outcome(F.lit("It falls. It breaks. To recover, sweep it up."))) == "It falls. It breaks."


def test_rewrites_are_held_to_the_draft(spark):
    from quern.operators import rewrite

    def found(answer, draft='The "red lid" covers the cup_rim.'):
        return one(spark, rewrite.problems(F.lit(answer), F.lit(draft), F.lit("What covers the cup?"), F.array(F.lit("red lid")), F.array(F.lit("kettle"))))

    assert found('Here the "red lid" covers the cup_rim.') == []
    assert found("As an AI, a kettle boils at frame_3") == ["leak", "missing_span", "missing_token", "missing_quote", "distractor", "novel_words", "banned"]
    assert one(spark, rewrite.chosen(F.lit("a"), F.lit("b"), F.lit("c"), F.lit(False), F.lit(True))) == "b"


def test_endpoints_rest_after_failures(tmp_path):
    from quern.operators.endpoints import AnswerCache, EndpointPool, canonical_hash, read_endpoints

    (tmp_path / "e.json").write_text('{"g": [{"url": "a:1/", "weight": 2}, "http://b"]}')
    weights = read_endpoints(str(tmp_path / "e.json"))
    assert weights == {"http://a:1": 2.0, "http://b": 1.0}
    clock = [0.0]
    pool = EndpointPool(weights, now=lambda: clock[0])
    assert sorted(pool.pick() for _ in range(6)) == ["http://a:1"] * 4 + ["http://b"] * 2
    for _ in range(3):
        pool.report("http://a:1", False)
    assert {pool.pick() for _ in range(4)} == {"http://b"}
    clock[0] = 31.0
    assert "http://a:1" in {pool.pick() for _ in range(3)}
    cache = AnswerCache(2)
    for k in "abc":
        cache.put(k, k)
    assert cache.get("a") is None and cache.get("c") == "c"
    assert canonical_hash({"b": 1, "a": [1.0]}) == canonical_hash({"a": [1.0], "b": 1})
