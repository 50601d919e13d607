"""Reasoning traces: metrics, the ordered chain of checks, and coverage of keyword clusters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import any_of, half_repetition, indicator_density, let, novelty, sentence_repetition, sentences, share, words

# Least length of a trace and least share of reasoning words, by task.
MIN_CHARS = {
    "Task_01": 950, "Task_02": 1150, "Task_03": 1250, "Task_04": 1000, "Task_05": 1200, "Task_06": 950, "Task_07": 1000,
    "Task_08": 1000, "Task_09": 950, "Task_10": 1000, "Task_11": 1050, "Task_12": 1050, "Task_13": 1100, "Task_14": 1100,
    "Task_15": 1250, "Task_16": 1250, "Task_17": 1200, "Task_18": 1250, "Task_19": 1400, "Task_20": 1300,
}
DENSITY = {
    "Task_01": 0.02, "Task_02": 0.02, "Task_03": 0.04, "Task_04": 0.025, "Task_05": 0.03, "Task_06": 0.02, "Task_07": 0.02,
    "Task_09": 0.025, "Task_11": 0.025, "Task_12": 0.02, "Task_13": 0.025, "Task_14": 0.035, "Task_15": 0.025, "Task_16": 0.02,
    "Task_17": 0.025, "Task_18": 0.025, "Task_19": 0.04,
}
SHORT_ANSWERS = ["Task_01", "Task_02", "Task_03", "Task_08", "Task_09", "Task_10", "Task_11", "Task_15", "Task_19"]
KEYWORD_SHARE = {"Task_09": 0.10, "Task_18": 0.10}
# Phrases that must not occur anywhere, near the start, near the end.
BAD_ANYWHERE = [
    "as an ai", "i don't have access", "i can't see", "from the json", "the context says", "according to the evidence provided",
    "based on the provided context", "based on the provided information", "the user wants me to", "the user is asking",
    "i should think about", "i need to figure out", "my task is to", "the question asks me", "i'm being asked to", "let me consider",
]
BAD_AT_START = ["let me think", "let me analyze", "let me start", "i need to analyze", "i need to think"]
BAD_AT_END = ["therefore the answer", "in conclusion,", "in summary,"]
SUFFIXES = ["tion", "sion", "ment", "ness", "ally", "ying", "ing", "ous", "ive", "ful", "less", "able", "ible", "ied", "ies", "ely", "ed", "ly", "es", "er", "s"]
MARKS = ".,;:!?()[]\"'"
REASONING_WORDS = [
    "because", "therefore", "since", "implies", "indicates", "suggests", "confirms", "enables", "prevents", "requires", "depends", "causes",
    "leads", "results", "means", "consequently", "however", "although", "whereas", "instead", "otherwise", "without", "if", "would",
    "could", "cannot", "insufficient", "necessary", "sufficient", "gravity", "friction", "force", "torque", "leverage", "pressure",
    "trajectory", "contact", "surface", "grip", "rigid", "flexible", "weight", "momentum", "constraint", "mechanism", "precondition",
    "postcondition", "affordance", "state", "spatial", "functional", "counterfactual", "failure", "recovery", "restore", "cascade",
    "downstream", "upstream", "dependency", "condition", "effect", "transition", "disambiguates", "alternative", "preconditions",
    "postconditions", "affordances", "states", "conditions", "effects", "transitions", "dependencies", "restores", "restored", "restoring",
]


def _by_task(task: Column, table: dict, default) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for item in table.items() for x in item]), task), F.lit(default))


def rough_stem(word: Column) -> Column:
    """Lower-case word without marks and the first ending that leaves three letters."""
    w = F.btrim(F.lower(word), F.lit(MARKS))
    out = w
    for s in reversed(SUFFIXES):
        out = F.when(F.endswith(w, F.lit(s)) & (F.length(w) - len(s) >= 3), F.substring(w, F.lit(1), F.length(w) - len(s))).otherwise(out)
    return out


def content_stems(text: Column) -> Column:
    return F.transform(F.filter(words(text), lambda w: F.length(F.btrim(w, F.lit(MARKS))) > 2), rough_stem)


def tail_overlap(trace: Column, answer: Column) -> Column:
    """Greatest share of content words of the last, or the last two, sentences whose stems stand in the answer; 0 under three sentences."""

    def rate(s: Column, own: Column) -> Column:
        def part(text: Column) -> Column:
            return let(content_stems(text), lambda t: share(F.size(F.filter(t, lambda x: F.array_contains(own, x))), F.size(t)))

        last, two = F.element_at(s, -1), F.array_join(F.slice(s, F.size(s) - 1, F.lit(2)), " ")
        return F.when(F.size(own) == 0, F.lit(0.0)).otherwise(F.greatest(part(last), part(two)))

    stems = lambda s: let(F.array_distinct(content_stems(answer)), lambda own: rate(s, own))
    return let(sentences(trace, 10), lambda s: F.when(F.size(s) < 3, F.lit(0.0)).otherwise(stems(s)))


def keyword_share(trace: Column, answer: Column) -> Column:
    """Share of the answer's distinct words of four letters or more that the trace has; null if it has none."""
    long_words = lambda t: F.array_distinct(F.filter(words(F.lower(t)), lambda w: F.length(w) > 3))
    return let(long_words(answer), lambda a: F.when(F.size(a) > 0, F.size(F.array_intersect(a, long_words(trace))) / F.size(a)))


def least_chars(task: Column, answer: Column) -> Column:
    factor = F.when(task.isin(SHORT_ANSWERS), F.lit(4.0)).otherwise(F.lit(2.5))
    return F.least(F.lit(1800), F.greatest(_by_task(task, MIN_CHARS, 200), F.floor(F.length(F.trim(answer)) * factor).cast("int")))


def reasoning_steps(trace: Column) -> Column:
    return F.size(F.filter(F.split(F.replace(F.trim(trace), F.lit("\n"), F.lit(". ")), r"\. "), lambda s: F.length(F.trim(s)) > 10))


def covered(text: Column, clusters: dict[str, list[str]]) -> Column:
    """Names of clusters of which a keyword stands in the lower-case text."""
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(any_of(low, keys), F.lit(name)) for name, keys in clusters.items()]))


def structure_ok(text: Column, clusters: dict[str, list[str]]) -> Column:
    return F.size(covered(text, clusters)) >= max(1, int(len(clusters) * 0.6))


def contract_ok(text: Column, clusters: dict[str, list[str]]) -> Column:
    """Enough clusters, and the last (the task's own) among them."""
    return let(covered(text, clusters), lambda c: (F.size(c) >= max(3, int(len(clusters) * 0.6))) & F.array_contains(c, list(clusters)[-1]))


def first_failure(trace: Column, answer: Column, task: Column, indicators: list[str] = REASONING_WORDS, structure: Column | None = None, contract: Column | None = None) -> Column:
    """Name of the first check that a trace fails, else 'ok'. structure and contract are conditions of the caller's clusters."""
    text, low = F.trim(F.coalesce(trace, F.lit(""))), F.lower(F.trim(F.coalesce(trace, F.lit(""))))
    least_steps = F.when(task.isin(list(MIN_CHARS)), 5).otherwise(3)
    repetition = F.greatest(half_repetition(text), sentence_repetition(text))  # the chain gets there for few texts
    checks = [
        ("empty", text == ""),
        ("too_short", F.length(text) < least_chars(task, answer)),
        ("few_steps", reasoning_steps(text) < least_steps),
        ("keyword_overlap", keyword_share(text, answer) < _by_task(task, KEYWORD_SHARE, 0.15)),
        ("verbatim", F.contains(text, F.trim(answer))),
        ("restatement", novelty(text, answer) < 0.5),
        ("indicators", indicator_density(text, indicators) < _by_task(task, DENSITY, 0.03)),
        ("bad_phrase", any_of(low, BAD_ANYWHERE)),
        ("bad_start", any_of(F.substring(low, 1, 80), BAD_AT_START)),
        ("bad_end", any_of(F.substring(low, F.greatest(F.lit(1), F.length(low) - 99), F.lit(100)), BAD_AT_END)),
        ("repetitive", repetition > 0.15),
        ("structure", ~structure if structure is not None else F.lit(False)),
        ("contract", ~contract if contract is not None else F.lit(False)),
        ("tail_copy", tail_overlap(text, answer) > 0.8),
    ]
    out = F.lit("ok")
    for name, failed in reversed(checks):
        out = F.when(failed, F.lit(name)).otherwise(out)
    return out


def template_patterns(text: Column) -> Column:
    """How many headings, numbered lists and step labels a trace has."""
    count = lambda p: F.size(F.regexp_extract_all(text, F.lit(p), F.lit(0)))
    numbered = count(r"(?m)^[0-9]+\.\s")
    return count(r"(?m)^[A-Z][A-Z\s]{2,30}:") + count(r"PARAGRAPH\s*[0-9]") + F.when(numbered >= 5, 1).otherwise(0) + count(r"(?im)^(?:Step|Phase|Layer|Stage|Part)\s*[0-9]+\s*[:\-—]")
