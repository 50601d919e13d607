"""Scores of judge responses, rubric answers and rewards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.json import kind_at, object_of, text_at, texts_at
from quern.functions.text import any_of, let, literal_array, reward_tokens, share, token_f1, token_recall

# Highest overall score that a failure tag allows, for two axes and for five.
TWO_AXIS_CAPS = {
    "missing_visual_evidence": 0.0, "visual_hallucination": 24.0, "question_answer_mismatch": 34.0,
    "unsupported_causal_claim": 44.0, "contradiction": 34.0, "wrong_step": 34.0, "impossible_physics": 24.0,
    "timeline_mismatch": 34.0, "parse_error": 0.0, "preflight_error": 0.0,
}
FIVE_AXIS_CAPS = {
    "missing_visual_evidence": 0.0, "violated_precondition": 34.0, "unsupported_causal_dependency": 44.0,
    "impossible_state_transition": 24.0, "timeline_mismatch": 34.0, "hallucinated_effect": 24.0,
    "physical_infeasibility": 24.0, "qa_misalignment": 34.0, "parse_error": 0.0, "preflight_error": 0.0,
}
# Axes with their rationales.
TWO_AXES = {"visual_grounding_score": "visual_grounding_rationale", "logical_coherence_score": "logical_coherence_rationale"}
FIVE_AXES = {
    "precondition_validity_score": "precondition_rationale",
    "causal_dependency_score": "causal_dependency_rationale",
    "state_transition_score": "state_transition_rationale",
    "timeline_consistency_score": "timeline_rationale",
    "physical_feasibility_score": "physical_feasibility_rationale",
}
# Statuses of the two binary audits, the tags that reject, and words for a pass.
UNIFIED_STATUSES = ["visual_grounding", "logical_coherence", "qa_alignment"]
UNIFIED_REJECTS = [
    "visual_hallucination", "missing_visual_evidence", "question_answer_mismatch", "unsupported_causal_claim",
    "contradiction", "wrong_step", "impossible_physics", "timeline_mismatch", "parse_error", "preflight_error",
]
PHYSICAL_STATUSES = ["precondition_validity", "causal_dependency", "state_transition", "timeline_consistency", "physical_feasibility", "qa_alignment"]
PHYSICAL_REJECTS = [
    "violated_precondition", "unsupported_causal_dependency", "impossible_state_transition", "timeline_mismatch",
    "hallucinated_effect", "physical_infeasibility", "qa_misalignment", "missing_visual_evidence", "wrong_step",
    "parse_error", "preflight_error",
]
PASS_WORDS = ["pass", "passed", "yes", "true", "ok", "acceptable", "accept"]
# Rubric answers, and the caps of diagnostics answered Yes.
ANSWER_VALUES = {"Yes": 1.0, "Partially": 0.5, "No": 0.0}
DIAGNOSTIC_CAPS = {"d1": 0.35, "d2": 0.60, "d3": 0.25, "d4": 0.50, "d5": 0.45, "d6": 0.50}
RUBRIC_TASKS = {
    "Task_01": (5, 5), "Task_02": (5, 5), "Task_06": (5, 5), "Task_07": (5, 5), "Task_18": (6, 6), "Task_19": (5, 5), "Task_20": (5, 5),
}
# Share of the rule in the final reward, and weights of the rules' parts.
ALPHA = {"Task_01": 0.15, "Task_02": 0.0, "Task_06": 0.0, "Task_07": 0.0, "Task_18": 0.25, "Task_19": 0.0, "Task_20": 0.0}
FACT_WEIGHTS = (0.70, 0.20, 0.10)
REPAIR_WEIGHTS = (0.15, 0.20, 0.50, 0.15)
RECOVERY_WEIGHTS = (0.45, 0.20, 0.20, 0.15)
FAILURE_SCORE = -1.0
# Words that show an action, and phrases that name a flaw.
ACTION_TERMS = [
    "adjust", "align", "clear", "close", "continue", "hold", "insert", "lift", "lower", "move", "open", "place", "press",
    "pull", "push", "reinsert", "re-lower", "remove", "repeat", "reposition", "restart", "secure", "separate", "spread",
    "stabilize", "turn", "widen",
]
FLAW_PHRASES = {
    "goal_inconsistent": ["contradict", "wrong goal", "goal-inconsistent", "inconsistent with the goal", "does not advance", "irrelevant", "unrelated"],
    "granularity_mismatch": ["too vague", "overly general", "granularity", "not specific", "lacks detail", "too broad"],
    "precondition_missing": ["missing precondition", "without first", "before", "prerequisite", "required condition", "not yet"],
    "redundant_step": ["redundant", "duplicate", "repeats", "unnecessary", "already done", "superfluous"],
    "wrong_ordering": ["wrong order", "out of order", "sequence", "should occur before", "should occur after", "too early", "too late"],
}
BANDS_100 = [(0, 25, "0-24"), (25, 50, "25-49"), (50, 75, "50-74"), (75, 90, "75-89"), (90, 101, "90-100")]


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def tag_list(tags: Column) -> Column:
    """Lower-case tags without words for none; ['none'] if nothing is left."""
    kept = F.filter(F.transform(tags, lambda t: F.lower(F.trim(t))), lambda t: ~t.isin("none", "n/a", "na", "null", ""))
    return let(kept, lambda k: F.when(F.size(k) == 0, F.array(F.lit("none"))).otherwise(k))


def axis_score(v: Column, key: str) -> Column:
    """Field as a score 0 to 100 of three places; null for truth values, other types and what is not finite."""
    kind = kind_at(v, key)
    x = F.try_variant_get(v, f"$.{key}", "double")
    text = F.try_variant_get(v, f"$.{key}", "string").try_cast("double")
    number = F.when(kind == "BOOLEAN", F.lit(None)).when(kind == "STRING", text).otherwise(x)
    return F.when(F.abs(number) < float("inf"), clamp(F.round(number, 3), 0.0, 100.0))


def _capped(tags: Column, caps: dict[str, float]) -> Column:
    table = F.create_map(*[F.lit(x) for item in caps.items() for x in item])
    return F.coalesce(F.array_min(F.transform(tags, lambda t: F.coalesce(F.try_element_at(table, t), F.lit(100.0)))), F.lit(100.0))


def axes_score(raw: Column, axes: dict[str, str], caps: dict[str, float], slack: float, low_axis: bool) -> Column:
    """Struct of a scored response: every axis, overall, tags, confidence, warnings, parse_error.

    overall = least of the axes' mean, the lowest axis plus `slack`, the caps of its tags, 60 if a
    rationale is missing and (low_axis) 34 or 64 for a lowest axis under 25 or 50. What cannot be
    parsed scores zero and says so; nothing is dropped.
    """

    def made(v: Column) -> Column:
        scores = [axis_score(v, k) for k in axes]
        bad = v.isNull()
        for s in scores:
            bad = bad | s.isNull()
        tags = tag_list(texts_at(v, "major_failure_tags", "failure_tags"))
        if low_axis:
            effects = texts_at(v, "hallucinated_effects")
            tags = let(tags, lambda t: F.when((F.size(effects) > 0) & ~F.array_contains(t, "hallucinated_effect"), F.concat(F.filter(t, lambda x: x != "none"), F.array(F.lit("hallucinated_effect")))).otherwise(t))
        missing = F.lit(False)
        for r in axes.values():
            missing = missing | (text_at(v, r) == "")
        confidence = F.lower(text_at(v, "score_confidence"))

        def whole(t: Column) -> Column:
            def valued(s: Column) -> Column:
                low = F.array_min(s)
                total = F.aggregate(s, F.lit(0.0), lambda a, x: a + x)
                limits = [F.round(total / F.lit(float(len(axes))), 3), low + F.lit(slack), _capped(t, caps), F.when(missing, F.lit(60.0)).otherwise(F.lit(100.0))]
                if low_axis:
                    limits.append(F.when(low < 25, F.lit(34.0)).when(low < 50, F.lit(64.0)).otherwise(F.lit(100.0)))
                return F.when(bad, F.lit(0.0)).otherwise(F.round(clamp(F.least(*limits), 0.0, 100.0), 3))

            hard = F.filter(t, lambda x: x.isin(list(caps)))
            return F.struct(
                *[F.when(bad, F.lit(0.0)).otherwise(s).alias(k) for k, s in zip(axes, scores)],
                let(F.array(*scores), valued).alias("overall"),
                F.when(bad, F.array(F.lit("parse_error"))).otherwise(t).alias("tags"),
                F.when(bad, F.lit("low")).when(confidence.isin("low", "medium", "high"), confidence).otherwise(F.lit("medium")).alias("confidence"),
                F.when(bad, F.array(F.lit("parse_error"))).otherwise(
                    F.concat(F.transform(hard, lambda x: F.concat(F.lit("hard_cap:"), x)), F.when(missing, F.array(F.lit("missing_rationale"))).otherwise(F.array().cast("array<string>")))
                ).alias("warnings"),
                bad.alias("parse_error"),
            )

        return let(tags, whole)

    return let(object_of(raw), made)


def two_axis(raw: Column) -> Column:
    return axes_score(raw, TWO_AXES, TWO_AXIS_CAPS, 20.0, False)


def five_axis(raw: Column) -> Column:
    return axes_score(raw, FIVE_AXES, FIVE_AXIS_CAPS, 15.0, True)


def binary_audit(raw: Column, statuses: list[str] = PHYSICAL_STATUSES, rejects: list[str] = PHYSICAL_REJECTS, effects: bool = True) -> Column:
    """Struct (decision, statuses, tags, parse_error).

    Accepted if it says ACCEPT, every status passes, no tag rejects (and no effect is
    hallucinated); if it says neither ACCEPT nor REJECT, if all pass and there is no tag at all.
    """

    def made(v: Column) -> Column:
        status = [F.when(F.lower(text_at(v, k)).isin(PASS_WORDS), F.lit("pass")).otherwise(F.lit("fail")) for k in statuses]
        passed = F.lit(True)
        for s in status:
            passed = passed & (s == "pass")
        seen = texts_at(v, "hallucinated_effects")
        none = F.size(seen) == 0 if effects else F.lit(True)
        tags = tag_list(texts_at(v, "failure_tags", "major_failure_tags"))
        if effects:
            tags = let(tags, lambda t: F.when((F.size(seen) > 0) & ~F.array_contains(t, "hallucinated_effect"), F.concat(F.filter(t, lambda x: x != "none"), F.array(F.lit("hallucinated_effect")))).otherwise(t))
        said = F.upper(text_at(v, "decision"))

        def whole(t: Column) -> Column:
            active = F.filter(t, lambda x: x != "none")
            hard = F.exists(active, lambda x: x.isin(rejects))
            accept = F.when(said.isin("ACCEPT", "REJECT"), (said == "ACCEPT") & passed & none & ~hard).otherwise(passed & none & (F.size(active) == 0))
            accept = accept & v.isNotNull()
            fallback = "physical_logic_rejected" if effects else "judge_rejected"
            return F.struct(
                F.when(accept, F.lit("ACCEPT")).otherwise(F.lit("REJECT")).alias("decision"),
                *[F.when(v.isNull(), F.lit("fail")).otherwise(s).alias(k) for k, s in zip(statuses, status)],
                F.when(v.isNull(), F.array(F.lit("parse_error"))).when(~accept & (F.size(active) == 0), F.array(F.lit(fallback))).otherwise(t).alias("tags"),
                v.isNull().alias("parse_error"),
            )

        return let(tags, whole)

    return let(object_of(raw), made)


def unified_audit(raw: Column) -> Column:
    return binary_audit(raw, UNIFIED_STATUSES, UNIFIED_REJECTS, False)


def band_100(score: Column) -> Column:
    out = F.lit(None).cast("string")
    for low, high, name in reversed(BANDS_100):
        out = F.when((score >= low) & (score < high), F.lit(name)).otherwise(out)
    return out


def open_score(raw: Column) -> Column:
    """Score of three places in 0 ... 1 of a judge's response, else null."""

    def made(v: Column) -> Column:
        kind, x = kind_at(v, "score"), F.try_variant_get(v, "$.score", "double")
        number = F.when(kind == "BOOLEAN", F.lit(None)).when(kind == "STRING", F.trim(F.try_variant_get(v, "$.score", "string")).try_cast("double")).otherwise(x)
        return let(F.round(number, 3), lambda s: F.when((s >= 0) & (s <= 1), s))

    return let(object_of(raw), made)


def open_band(score: Column) -> Column:
    return F.when(score.isNull(), F.lit("parse_error")).when(score < 0.25, "[0.000,0.250)").when(score < 0.5, "[0.250,0.500)").when(score < 0.75, "[0.500,0.750)").otherwise("[0.750,1.000]")


def rubric_score(task: Column, answers: Column, diagnostics: Column, evidence: Column, valid: Column) -> Column:
    """Struct (score, status). Maps of question to answer; each must hold the task's keys.

    The mean of Yes 1, Partially .5, No 0 (no Partially for Task_18), but at most the cap of each
    diagnostic answered Yes. Invalid input scores -1; missing or wrong answers are errors with null score.
    """
    norm = lambda x: F.initcap(F.lower(F.trim(x)))
    counts = F.create_map(*[F.lit(x) for k, (q, _) in RUBRIC_TASKS.items() for x in (k, q)])
    n = F.try_element_at(counts, task)
    keys = F.transform(F.sequence(F.lit(1), F.coalesce(n, F.lit(1))), lambda i: F.concat(F.lit("q"), i.cast("string")))
    marks = F.transform(F.sequence(F.lit(1), F.coalesce(n, F.lit(1))), lambda i: F.concat(F.lit("d"), i.cast("string")))
    values = F.create_map(*[F.lit(x) for item in ANSWER_VALUES.items() for x in item])
    caps = F.create_map(*[F.lit(x) for item in DIAGNOSTIC_CAPS.items() for x in item])
    given = F.transform(keys, lambda k: F.try_element_at(values, norm(F.try_element_at(answers, k))))
    partial = F.exists(keys, lambda k: norm(F.try_element_at(answers, k)) == "Partially") & (task == "Task_18")
    cap = F.array_min(F.transform(marks, lambda k: F.when(norm(F.try_element_at(diagnostics, k)) == "Yes", F.try_element_at(caps, k)).otherwise(F.lit(1.0))))
    status = (
        F.when(n.isNull(), F.lit("unknown_task"))
        .when(~F.coalesce(valid, F.lit(True)), F.lit("invalid_judge_input"))
        .when(F.exists(keys, lambda k: F.try_element_at(answers, k).isNull()), F.lit("missing_answers"))
        .when(F.exists(given, lambda x: x.isNull()) | partial, F.lit("invalid_answer_choice"))
        .when(F.exists(marks, lambda k: F.try_element_at(diagnostics, k).isNull()), F.lit("missing_diagnostics"))
        .when(F.exists(marks, lambda k: ~norm(F.try_element_at(diagnostics, k)).isin("Yes", "No")), F.lit("invalid_diagnostic_choice"))
        .when(F.exists(keys, lambda k: F.trim(F.coalesce(F.try_element_at(evidence, k), F.lit(""))) == ""), F.lit("missing_evidence"))
        .otherwise(F.lit("ok"))
    )
    mean = F.aggregate(given, F.lit(0.0), lambda a, x: a + x) / F.size(given)
    return let(status, lambda s: F.struct(F.when(s == "invalid_judge_input", F.lit(FAILURE_SCORE)).when(s == "ok", clamp(F.least(mean, cap))).alias("score"), s.alias("status")))


def average(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)).otherwise(F.lit(0.0))


def fact_reward(response: Column, facts: Column, target: Column, patient: Column) -> Column:
    """Weighted mean of the facts' token recall, similarity to the target text, and mention of the patient."""
    w = FACT_WEIGHTS

    def made(r: Column) -> Column:
        recall = average(F.transform(facts, lambda f: token_recall(r, reward_tokens(f))))
        named = F.when((F.coalesce(patient, F.lit("")) != "") & (token_recall(r, reward_tokens(patient)) > 0), F.lit(1.0)).otherwise(F.lit(0.0))
        return clamp(F.lit(w[0]) * recall + F.lit(w[1]) * token_f1(r, reward_tokens(target)) + F.lit(w[2]) * named)

    return let(reward_tokens(response), made)


def flaw_step_score(response: Column, step: Column) -> Column:
    """1 if the response names the step, .5 if a neighbour, else 0."""
    low = F.lower(response)
    numbers = F.transform(F.regexp_extract_all(low, F.lit(r"\bstep\s*([0-9]+)\b"), F.lit(1)), lambda x: x.try_cast("long"))
    ordinal = F.transform(F.regexp_extract_all(low, F.lit(r"\b([0-9]+)\s*(?:st|nd|rd|th)?\s+step\b"), F.lit(1)), lambda x: x.try_cast("long"))
    return (
        F.when(F.coalesce(step, F.lit(0)) <= 0, F.lit(0.0))
        .when(F.array_contains(numbers, step.cast("long")) | F.array_contains(ordinal, step.cast("long")), F.lit(1.0))
        .when(F.exists(numbers, lambda x: F.abs(x - step) == 1), F.lit(0.5))
        .otherwise(F.lit(0.0))
    )


def flaw_type_score(response: Column, flaw: Column) -> Column:
    kind, low = F.lower(F.trim(flaw)), F.lower(response)
    named = F.lit(False)
    for k, phrases in FLAW_PHRASES.items():
        named = named | ((kind == k) & any_of(low, phrases))
    return F.when(F.coalesce(kind, F.lit("")) == "", F.lit(0.0)).when(F.contains(low, kind) | named, F.lit(1.0)).otherwise(token_f1(reward_tokens(response), reward_tokens(F.replace(kind, F.lit("_"), F.lit(" ")))))


def repair_reward(response: Column, step: Column, flaw: Column, bad: Column, repair: Column) -> Column:
    """Weighted mean of the named step, the named flaw, coverage of the repair, and not copying the bad plan."""
    w = REPAIR_WEIGHTS
    low = F.lower(response)

    def made(x: Column) -> Column:
        cover, copied = x["cover"], x["copied"]
        honest = (
            F.when((copied > 0.65) & (cover < 0.45), F.lit(0.25))
            .when((copied > 0.75) & ~F.contains(low, F.lit("corrected")) & ~F.contains(low, F.lit("repair")), F.lit(0.55))
            .otherwise(F.lit(1.0))
        )
        return clamp(F.lit(w[0]) * flaw_step_score(response, step) + F.lit(w[1]) * flaw_type_score(response, flaw) + F.lit(w[2]) * cover + F.lit(w[3]) * honest)

    mean = lambda r, steps: average(F.transform(steps, lambda s: token_recall(r, reward_tokens(s))))
    return let(reward_tokens(response), lambda r: let(F.struct(mean(r, repair).alias("cover"), mean(r, bad).alias("copied")), made))


def recovery_reward(response: Column, failure: Column, strategy: Column, goal: Column) -> Column:
    """Weighted mean of covering the recovery, showing an action, saying new things and meeting the failure;
    at most .30 or .55 if the failure is repeated and hardly any recovery given."""
    w = RECOVERY_WEIGHTS

    def made(x: Column) -> Column:
        r, f, s, g = x["r"], x["f"], x["s"], x["g"]
        cover, parrot = token_recall(r, s), token_recall(r, f)
        acts = F.when(F.size(F.array_intersect(r, literal_array(ACTION_TERMS))) > 0, F.lit(1.0)).otherwise(F.lit(0.0))
        signal = clamp(F.lit(0.45) * acts + F.lit(0.55) * F.greatest(cover, token_recall(r, g)))
        fresh = share(F.size(F.array_except(r, f)), F.size(r))
        met = F.when((cover >= 0.35) & (parrot > 0), F.lit(1.0)).otherwise(cover)
        raw = F.lit(w[0]) * cover + F.lit(w[1]) * signal + F.lit(w[2]) * fresh + F.lit(w[3]) * met
        cap = F.when((parrot >= 0.45) & (cover < 0.25), F.lit(0.30)).when((parrot >= 0.65) & (cover < 0.45), F.lit(0.55)).otherwise(F.lit(1.0))
        return clamp(F.least(raw, cap))

    return let(F.struct(reward_tokens(response).alias("r"), reward_tokens(failure).alias("f"), reward_tokens(strategy).alias("s"), reward_tokens(goal).alias("g")), made)


def blended(task: Column, rule: Column, judge: Column) -> Column:
    """alpha * rule + (1 - alpha) * judge in 0 ... 1; a failed judge is -1, an unknown task null."""
    alpha = F.try_element_at(F.create_map(*[F.lit(x) for item in ALPHA.items() for x in item]), task)
    return F.when(alpha.isNull(), F.lit(None).cast("double")).when(judge < 0, F.lit(FAILURE_SCORE)).otherwise(clamp(alpha * rule + (F.lit(1.0) - alpha) * judge))


# Fields that a reward needs, by task; the second lists may be missing.
REWARD_KEYS = {
    "Task_01": ["spatial_preconditions", "spatial_preconditions_pts", "step_goal", "patient"],
    "Task_02": ["affordance_preconditions", "affordance_preconditions_pts", "step_goal", "patient"],
    "Task_06": ["spatial_postconditions", "spatial_postconditions_pts", "step_goal", "patient"],
    "Task_07": ["affordance_postconditions", "affordance_postconditions_pts", "step_goal", "patient"],
    "Task_18": ["high_level_goal", "bad_plan_steps", "repair_steps", "flaw_step", "flaw_type", "prefix_end_step_id"],
    "Task_19": ["step_goal", "counterfactual_challenge_question", "expected_challenge_outcome", "expected_outcome"],
    "Task_20": ["step_goal", "failure_reason", "recovery_strategy"],
}
MORE_REWARD_KEYS = {"Task_20": ["counterfactual_context", "counterfactual_outcome"]}
REWARD_RULES = {"Task_01": "fact", "Task_02": "fact", "Task_06": "fact", "Task_07": "fact", "Task_18": "repair", "Task_19": "disabled", "Task_20": "recovery"}


def reward_rule(task: Column, response: Column) -> Column:
    """Which rule scores a response: 'empty' and 'disabled' score 0, 'unknown' tasks cannot be scored."""
    rule = F.try_element_at(F.create_map(*[F.lit(x) for item in REWARD_RULES.items() for x in item]), task)
    return F.when(F.trim(F.coalesce(response, F.lit(""))) == "", F.lit("empty")).otherwise(F.coalesce(rule, F.lit("unknown")))


def rule_score(task: Column, response: Column, scores: dict[str, Column]) -> Column:
    """The score of the task's rule, given each rule's; unknown tasks raise."""
    rule = reward_rule(task, response)
    out = F.when(rule.isin("empty", "disabled"), F.lit(0.0))
    for name, score in scores.items():
        out = out.when(rule == name, score)
    return out.otherwise(F.raise_error(F.concat(F.lit("no reward for task "), F.coalesce(task, F.lit("null")))).cast("double"))


def missing_fields(task: Column, fields: Column) -> Column:
    """Needed fields of a task that a map of texts (lists as JSON) lacks; empty for tasks without a reward."""
    out = F.array().cast("array<string>")
    for name, keys in REWARD_KEYS.items():
        out = F.when(task == name, F.filter(literal_array(keys), lambda k: F.coalesce(F.try_element_at(fields, k), F.lit("")).isin("", "[]"))).otherwise(out)
    return out


def reward_fields(task: Column, fields: Column) -> Column:
    """The map of texts that a task's reward reads; null for a task without one.

    Facts have one form for all four fact tasks: target_text, target_facts, step_goal, patient, and the
    domain and stage that the field names say.
    """
    at = lambda k: F.trim(F.coalesce(F.try_element_at(fields, F.lit(k)), F.lit("")))
    made = lambda **kv: F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), v)])
    out = F.lit(None).cast("map<string,string>")
    for name, keys in REWARD_KEYS.items():
        if REWARD_RULES[name] == "fact":
            domain, stage = keys[0].removesuffix("s").split("_")
            new = made(target_text=at(keys[0]), target_facts=at(keys[1]), step_goal=at("step_goal"), patient=at("patient"), fact_domain=F.lit(domain), fact_stage=F.lit(stage))
        else:
            new = made(**{("counterfactual_condition" if k == "counterfactual_challenge_question" else k): at(k) for k in keys})
            for k in MORE_REWARD_KEYS.get(name, []):
                new = F.when(at(k) != "", F.map_concat(new, made(**{k: at(k)}))).otherwise(new)
        out = F.when(task == name, new).otherwise(out)
    return out
