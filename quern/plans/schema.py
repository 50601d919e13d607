"""Errors of plan documents (VARIANT), as arrays of codes; an empty array is a valid plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.leak import has_frame_reference, has_leak, has_time_reference
from quern.functions.text import let, share, words

# Keys of a plan and its parts; those marked optional may be missing.
PLAN_KEYS = ["high_level_goal", "steps", "video_id", "source_video"]
PLAN_OPTIONAL = ["video_id", "source_video"]
STEP_KEYS = [
    "step_id", "step_goal", "rationale", "causal_chain", "counterfactual_challenge_question", "expected_challenge_outcome",
    "failure_reflecting", "critical_frames", "clip_relpath", "atomic_actions", "independence", "detail_independence",
]
STEP_OPTIONAL = ["clip_relpath", "atomic_actions", "independence", "detail_independence"]
CAUSAL_LISTS = ["causal_precondition_on_spatial", "causal_precondition_on_affordance", "causal_effect_on_spatial", "causal_effect_on_affordance"]
CHAIN_TEXTS = ["agent", "action", "patient"]
FAILURE_KEYS = ["reason", "recovery_strategy"]
FRAME_KEYS = ["frame_index", "action_state_change_description", "causal_chain", "interaction"]
INTERACTION_KEYS = ["patient", "affordance_type", "mechanism"]
# Openings that a counterfactual question must have, and words of goals that gather odds and ends.
COUNTERFACTUAL = r"(?i)^\s*(?:What\s+(?:if|would|could|happens)|How\s+would|If\s+|In\s+the\s+event|Suppose|Imagine|Assuming|Had\s+the)\b"
CATCH_ALL = r"(?i)\b(?:various|miscellaneous|rest of the|leftover|assorted)\b|\bremaining\s+(?:small|loose|other|misc|kitchen|items|objects|things|stuff)\b"
GOAL_STOPWORDS = [
    "the", "a", "an", "and", "or", "of", "to", "in", "on", "at", "for", "with", "from", "into", "onto", "off", "up", "down", "out",
    "is", "are", "it", "its", "this", "that", "by", "as",
]


def _join(*parts: Column) -> Column:
    return F.concat(*[F.coalesce(p, F.array().cast("array<string>")) for p in parts])


def _when(condition: Column, code: Column | str) -> Column:
    code = F.lit(code) if isinstance(code, str) else code
    return F.when(F.coalesce(condition, F.lit(False)), F.array(code))


def _at(path: Column, code: str) -> Column:
    return F.concat(path, F.lit(code))


def _fields(v: Column) -> Column:
    """The fields of an object, each taken out of it once; null if it is none."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def keys(m: Column, path: Column, allowed: list[str], optional: list[str] = ()) -> Column:
    """Extra and missing keys of an object's fields."""
    missing = [k for k in allowed if k not in optional]
    return let(
        F.map_keys(m),
        lambda h: _join(
            _when(F.size(F.array_except(h, F.array(*[F.lit(k) for k in allowed]))) > 0, _at(path, ":extra_keys")),
            _when(F.size(F.array_except(F.array(*[F.lit(k) for k in missing]), h)) > 0, _at(path, ":missing_keys")),
        ),
    )


def _field(m: Column, key: str) -> Column:
    return F.try_element_at(m, F.lit(key))


def text_field(m: Column, key: str, path: Column) -> Column:
    """A field must be a text that is not blank, of one line, without frame or file names."""
    read = lambda x: F.struct(F.schema_of_variant(x).alias("kind"), F.trim(F.try_variant_get(x, "$", "string")).alias("s"))

    def errors(x: Column) -> Column:
        kind, s = x["kind"], x["s"]
        return (
            F.when(kind.isNull(), F.array(_at(path, f".{key}:missing")))
            .when(kind != "STRING", F.array(_at(path, f".{key}:not_text")))
            .when(s == "", F.array(_at(path, f".{key}:empty")))
            .otherwise(_join(_when(F.contains(s, F.lit("\n")), _at(path, f".{key}:newline")), _when(has_leak(s), _at(path, f".{key}:leak"))))
        )

    return let(let(_field(m, key), read), errors)


def causal_list(m: Column, key: str, path: Column) -> Column:
    """A field must be a non-empty list of sentences: one line, no list marker, a full stop, no frame names."""

    def item(x: Column) -> Column:
        return F.when(F.schema_of_variant(x) != "STRING", F.array(_at(path, f".{key}:item_not_text"))).otherwise(let(F.trim(F.try_variant_get(x, "$", "string")), sentence))

    def sentence(s: Column) -> Column:
        return F.when(s == "", F.array(_at(path, f".{key}:item_empty"))).otherwise(
            _join(
                _when(F.contains(s, F.lit("\n")), _at(path, f".{key}:item_newline")),
                _when(s.rlike(r"^\s*[-*•]\s+") | s.rlike(r"^\s*[0-9]+\s*[.)、]\s*"), _at(path, f".{key}:item_numbered")),
                _when(~F.endswith(s, F.lit(".")), _at(path, f".{key}:item_no_stop")),
                _when(has_leak(s), _at(path, f".{key}:item_leak")),
            )
        )

    def errors(x: Column) -> Column:
        items = x["items"]
        return (
            F.when(x["v"].isNull(), F.array(_at(path, f".{key}:missing")))
            .when(items.isNull(), F.array(_at(path, f".{key}:not_list")))
            .when(F.size(items) == 0, F.array(_at(path, f".{key}:empty_list")))
            .otherwise(F.flatten(F.transform(items, item)))
        )

    return let(let(_field(m, key), lambda v: F.struct(v.alias("v"), F.try_variant_get(v, "$", "array<variant>").alias("items"))), errors)


def _int(x: Column) -> Column:
    """A whole number that is no truth value, else null."""
    return F.when(F.schema_of_variant(x) == "BIGINT", F.try_variant_get(x, "$", "bigint"))


def chain_errors(cc: Column, path: Column, texts: list[str]) -> Column:
    checks = lambda m: _join(keys(m, path, texts + CAUSAL_LISTS), *[text_field(m, k, path) for k in texts], *[causal_list(m, k, path) for k in CAUSAL_LISTS])
    return let(_fields(cc), lambda m: F.when(m.isNull(), F.array(_at(path, ":not_object"))).otherwise(checks(m)))


def _texts_of(v: Column, path: Column, names: list[str]) -> Column:
    """Errors of an object of texts."""
    return let(_fields(v), lambda m: _join(keys(m, path, names), *[text_field(m, k, path) for k in names]))


def frame_errors(cf: Column, path: Column) -> Column:
    def errors(m: Column) -> Column:
        return _join(
            keys(m, path, FRAME_KEYS),
            let(_int(_field(m, "frame_index")), lambda i: _join(_when(i.isNull(), _at(path, ".frame_index:not_int")), _when(i <= 0, _at(path, ".frame_index:below_1")))),
            text_field(m, "action_state_change_description", path),
            chain_errors(_field(m, "causal_chain"), _at(path, ".causal_chain"), []),
            _texts_of(_field(m, "interaction"), _at(path, ".interaction"), INTERACTION_KEYS),
        )

    return let(_fields(cf), errors)


def _two_frames(frames: Column, path: Column) -> Column:
    """Errors of a step's list of critical frames."""
    index = lambda i: _int(F.try_variant_get(F.get(frames, F.lit(i)), "$.frame_index", "variant"))
    return F.when(frames.isNull(), F.array(_at(path, ".critical_frames:not_list"))).otherwise(
        _join(
            _when(F.size(frames) != 2, _at(path, ".critical_frames:not_two")),
            F.flatten(F.transform(frames, lambda f, j: frame_errors(f, F.concat(path, F.lit(".critical_frames["), j.cast("string"), F.lit("]"))))),
            let(F.struct(index(0).alias("a"), index(1).alias("b")), lambda x: _join(_when(x["a"] == x["b"], _at(path, ".critical_frames:equal")), _when(x["a"] > x["b"], _at(path, ".critical_frames:decreasing")))),
        )
    )


def step_errors(st: Column, path: Column) -> Column:
    """Errors of a step. Every value is taken out of its object once: in lambdas Spark works out what is written twice twice."""

    def errors(m: Column) -> Column:
        question = F.try_variant_get(_field(m, "counterfactual_challenge_question"), "$", "string")
        return _join(
            keys(m, path, STEP_KEYS, STEP_OPTIONAL),
            let(_int(_field(m, "step_id")), lambda i: _join(_when(i.isNull(), _at(path, ".step_id:not_int")), _when(i <= 0, _at(path, ".step_id:below_1")))),
            *[text_field(m, k, path) for k in ("step_goal", "rationale", "counterfactual_challenge_question", "expected_challenge_outcome")],
            let(question, lambda q: _when((F.trim(q) != "") & ~q.rlike(COUNTERFACTUAL), _at(path, ":counterfactual_prefix"))),
            chain_errors(_field(m, "causal_chain"), _at(path, ".causal_chain"), CHAIN_TEXTS),
            _texts_of(_field(m, "failure_reflecting"), _at(path, ".failure_reflecting"), FAILURE_KEYS),
            let(F.try_variant_get(_field(m, "critical_frames"), "$", "array<variant>"), lambda f: _two_frames(f, path)),
        )

    return let(_fields(st), errors)


def plan_errors(plans: DataFrame, most: int = 80) -> DataFrame:
    """(item, errors) of plans (item, plan VARIANT): at most the first `most` codes of each.

    One expression over the list of steps, whatever its length; a plan is read in one row, without a join.
    """
    top = F.lit("top")

    def inner(steps: Column) -> Column:
        ids = F.array_compact(F.transform(steps, lambda st: _int(F.try_variant_get(st, "$.step_id", "variant"))))
        each = F.transform(steps, lambda st, i: step_errors(st, F.concat(F.lit("steps["), i.cast("string"), F.lit("]"))))
        twice = let(ids, lambda x: F.size(x) > F.size(F.array_distinct(x)))
        return _join(_when(steps.isNull(), "top.steps:not_list"), F.flatten(each), _when(twice, "steps.step_id:duplicate"))

    def errors(m: Column) -> Column:
        return _join(keys(m, top, PLAN_KEYS, PLAN_OPTIONAL), text_field(m, "high_level_goal", top), let(F.try_variant_get(_field(m, "steps"), "$", "array<variant>"), inner))

    return plans.select("item", F.slice(let(_fields(F.col("plan")), errors), F.lit(1), F.lit(most)).alias("errors"))


def content_words(goal: Column) -> Column:
    return F.array_except(F.array_distinct(words(F.lower(goal))), F.array(*[F.lit(w) for w in GOAL_STOPWORDS]))


def draft_errors(steps: DataFrame, least: int = 3, most: int = 9, ands: int = 5, commas: int = 5) -> DataFrame:
    """(item, errors) of drafted steps (item, step_id, step_goal): counts, references, bundled, vague, repeated and overlapping goals."""
    goal = F.trim(F.coalesce("step_goal", F.lit("")))
    after = F.lead(goal).over(Window.partitionBy("item").orderBy("step_id"))
    own, nxt = content_words(goal), content_words(F.col("after"))
    over = share(F.size(F.array_intersect(own, nxt)), F.least(F.size(own), F.size(nxt)))
    rows = steps.withColumn("after", after)
    checks = {
        "empty_goal": goal == "",
        "reference": has_frame_reference(goal) | has_time_reference(goal),
        "placeholder": F.startswith(goal, F.lit("unnamed_step_")),
        "mega_step": (F.regexp_count(goal, F.lit(r"(?i)\band\b")) >= ands) | (F.length(goal) - F.length(F.replace(goal, F.lit(","), F.lit(""))) >= commas),
        "catch_all": goal.rlike(CATCH_ALL),
        "overlap": F.col("after").isNotNull() & (over > 0.7),
        "vague": F.size(F.filter(words(F.lower(goal)), lambda w: (F.length(w) > 2) & ~w.isin(GOAL_STOPWORDS))) < 3,
    }
    per = rows.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(goal).alias("d"), *[F.max(c.cast("int")).alias(k) for k, c in checks.items()])
    found = [F.when(~F.col("n").between(least, most), F.lit("step_count")), *[F.when(F.col(k) == 1, F.lit(k)) for k in checks], F.when(F.col("d") < F.col("n"), F.lit("duplicate_goal"))]
    return per.select("item", F.array_join(F.array_compact(F.array(*found)), ",").alias("errors"))


def independence_errors(steps: DataFrame) -> DataFrame:
    """(item, step_id, error) of (independence, detail_independence): the first step has none, others yes or no, and yes needs a detail."""
    flag, detail = F.lower(F.trim(F.coalesce("independence", F.lit("")))), F.trim(F.coalesce("detail_independence", F.lit("")))
    first = F.row_number().over(Window.partitionBy("item").orderBy("step_id")) == 1
    error = F.when(first & (flag != ""), "first_step").when(~first & ~flag.isin("yes", "no"), "not_yes_or_no").when((flag == "yes") & (detail == ""), "no_detail").when((flag != "yes") & (detail != ""), "detail_without_yes")
    return steps.select("item", "step_id", error.alias("error")).where("error is not null")
