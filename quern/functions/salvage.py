"""What can still be read from loose text: JSON in prose, lists, statements, spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.morph import lower_first
from quern.functions.text import first_text, let

# Where JSON may stand in a response, in the order in which it is looked for.
JSON_PLACES = [r"\{[^{}]*\}", r"(?s)\[.*?\]", r"(?s)\{.*?\}", r"(?s)\{.*\}", r"(?s)\[.*\]"]
# Keys of facts whose values name things.
ENTITY_KEYS = ["entity", "object", "subject", "name", "patient", "tool", "item", "target", "agent", "receiver", "artifact", "resource", "actor"]
ENTITY_ENDS = ["_entity", "_object", "_target", "_agent"]
# Keys whose values are paths or ids and keep their underscores.
PATH_KEYS = ["clip_relpath", "video_id", "source_video", "keyframe_image_path", "start_image_relpath", "end_image_relpath"]


def salvaged(text: Column) -> Column:
    """The first JSON value that parses, as a VARIANT: of a code fence, the whole, then of the first match of each place in order."""
    tries = [F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)\s*```", 1), F.trim(text), *[F.regexp_extract(text, p, 0) for p in JSON_PLACES]]
    return F.coalesce(*[F.try_parse_json(F.nullif(t, F.lit(""))) for t in tries])


def candidates(question: Column, label: str = "candidate objects") -> Column:
    """The list of texts that a question shows as JSON after its label; empty without one."""
    after = F.regexp_extract(question, r"(?is)" + label + r'[^\[]*(\[(?:[^\[\]"]|"(?:[^"\\]|\\.)*")*\])', 1)
    found = F.from_json(F.nullif(after, F.lit("")), "array<string>")
    return F.coalesce(F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x != ""), F.array().cast("array<string>"))


def statements(block: Column) -> Column:
    """Lines of a block as statements: without bullets and numbers, blanks collapsed, a full stop at the end, repeats left out."""
    raw = F.trim(F.replace(F.coalesce(block, F.lit("")), F.lit("\\n"), F.lit("\n")))
    clean = lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"^\s*[-*•]\s+", ""), r"^\s*[0-9]+\s*[.)、]\s*", ""), r"\s+", " "))
    lines = F.filter(F.transform(F.split(raw, "\r?\n"), clean), lambda x: x != "")
    ended = F.transform(lines, lambda x: F.when(F.endswith(x, F.lit(".")), x).otherwise(F.concat(x, F.lit("."))))
    return let(ended, lambda e: F.filter(e, lambda x, i: F.array_position(F.transform(e, lambda y: F.lower(y)), F.lower(x)) == i + 1))


def fact_entities(facts: Column) -> Column:
    """Distinct values, lower-case with collapsed blanks, of the keys of facts (array of maps) that name things."""

    def names(fact: Column) -> Column:
        key = lambda k: F.lower(k)
        own = F.map_filter(fact, lambda k, v: (key(k).isin(ENTITY_KEYS) | key(k).rlike("(?:" + "|".join(ENTITY_ENDS) + ")$")) & (F.trim(F.coalesce(v, F.lit(""))) != ""))
        return F.transform(F.map_values(own), lambda v: F.trim(F.regexp_replace(F.lower(v), r"\s+", " ")))

    return F.array_distinct(F.flatten(F.transform(facts, names)))


def without_underscores(fields: Column) -> Column:
    """A map of texts with blanks for underscores, but in paths and ids."""
    return F.transform_values(fields, lambda k, v: F.when(k.isin(PATH_KEYS), v).otherwise(F.replace(v, F.lit("_"), F.lit(" "))))


def _ended_off(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), r"[.!?]+$", "")


def required_spans(task: Column, field: "callable", points: "callable") -> Column:
    """What a rewritten answer must still say, by task. field(name) is a text, points(name) an array of texts."""
    texts = lambda *names: F.array(*[field(n) for n in names])
    many = lambda name, rest: F.when(F.size(points(name)) >= 2, points(name)).otherwise(texts(rest))
    plain = lambda name: F.regexp_replace(F.trim(field(name)), r"\.+$", "")
    rules = {
        "Task_01": many("spatial_preconditions_pts", "spatial_preconditions"),
        "Task_02": many("affordance_preconditions_pts", "affordance_preconditions"),
        "Task_03": texts("spatial_precondition", "affordance_precondition"),
        "Task_04": F.array(lower_first(plain("patient")), F.replace(F.lower(field("affordance_type")), F.lit("_"), F.lit(" ")), lower_first(_ended_off(field("mechanism")))),
        "Task_05": texts("mechanism"),
        "Task_06": many("spatial_postconditions_pts", "spatial_postconditions"),
        "Task_07": many("affordance_postconditions_pts", "affordance_postconditions"),
        "Task_08": texts("high_level_goal"),
        "Task_09": points("key_objects"),
        "Task_10": texts("step_goal"),
        "Task_11": F.array(lower_first(plain("patient"))),
        "Task_12": texts("action_state_change_description"),
        "Task_13": texts("rationale"),
        "Task_14": texts("detail_independence"),
        "Task_15": texts("next_step_goal"),
        "Task_16": points("middle_step_goals"),
        "Task_17": points("next_step_goals"),
        "Task_18": F.concat(F.array(F.when(field("flaw_step").try_cast("int") > 0, F.concat(F.lit("step "), field("flaw_step")))), points("repair_steps")),
        "Task_19": texts("expected_outcome"),
        "Task_20": F.array(_ended_off(field("recovery_strategy"))),
    }
    out = F.array().cast("array<string>")
    for name, spans in rules.items():
        out = F.when(task == name, spans).otherwise(out)
    return F.filter(F.transform(out, lambda x: first_text(x)), lambda x: x != "")


def plain_words(text: Column) -> Column:
    """Lower-case text without marks, blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


def keyword_found(text: Column, keyword: Column) -> Column:
    """A keyword of one word is a word of the text; one of several stands in it as they are."""
    t, k = plain_words(text), plain_words(keyword)
    word = F.array_contains(F.split(t, " "), k)
    return (k != "") & F.when(F.contains(k, F.lit(" ")), F.contains(t, k)).otherwise(word)


def one_line(text: Column) -> Column:
    """Text in one line, blanks collapsed, without blanks before marks and without doubled marks."""
    s = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.regexp_replace(F.regexp_replace(s, r" +([,.;:!?])", "$1"), r"([,.;:!?])\1+", "$1")


def humanised(token: Column) -> Column:
    """A name of words joined by underscores as words."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(token, F.lit("")), r"[_\s]+", " "), r"^obj ", ""))


def required_object(text: Column) -> Column:
    """The JSON object of a response in or out of a code fence; raises if there is none."""
    from quern.functions.json import object_of

    found = object_of(F.coalesce(F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit("")), text))
    return F.when(found.isNull(), F.raise_error(F.concat(F.lit("no JSON object in: "), F.substring(text, 1, 80))).cast("variant")).otherwise(found)
