"""English forms: gerunds, progressive phrases, sentences from relations, ASCII names."""

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import let

# Words in -ing that are no gerunds, words that open no verb phrase, verbs that do not double their last letter.
NO_GERUNDS = ["swing", "bring", "ring", "sling", "cling", "fling", "sting", "wring", "string", "spring", "sing", "king", "thing"]
NO_VERBS = ["the", "a", "an", "this", "that", "these", "those", "it", "its", "if", "when", "while", "because", "since", "for", "by", "to", "from"]
NO_DOUBLING = ["open", "lower", "enter", "cover", "order", "offer", "power", "tower", "outer", "inner", "lever", "widen", "ripen", "happen", "listen"]


def lower_first(text: Column) -> Column:
    """First letter in lower case, unless the first word has another capital (a name or abbreviation)."""
    head = F.regexp_extract(text, r"^\S+", 0)
    return F.when(F.substring(head, F.lit(2), F.length(head)).rlike("[A-Z]"), text).otherwise(F.concat(F.lower(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text))))


def gerund(phrase: Column) -> Column:
    """'lift the lid' becomes 'lifting the lid'; phrases that do not begin with a plain verb stay.

    The English rule: a final e falls (not ee); a short word of consonant, vowel, consonant doubles the
    last letter, unless that is w, x or y or the stress lies before it (NO_DOUBLING).
    """
    s = F.trim(phrase)
    word = F.lower(F.regexp_extract(s, "^([A-Za-z]+)", 1))
    rest = F.substring(s, F.length(word) + 1, F.length(s))
    double = F.length(word).between(3, 5) & word.rlike("[^aeiou][aeiou][^aeiouwxy]$") & ~word.isin(NO_DOUBLING)
    made = (
        F.when(F.endswith(word, F.lit("e")) & ~F.endswith(word, F.lit("ee")), F.concat(F.substring(word, F.lit(1), F.length(word) - 1), F.lit("ing")))
        .when(double, F.concat(word, F.substring(word, F.length(word), F.lit(1)), F.lit("ing")))
        .otherwise(F.concat(word, F.lit("ing")))
    )
    made = F.when(s.rlike("^[A-Z]"), F.initcap(made)).otherwise(made)
    stays = (word == "") | word.isin(NO_VERBS) | (F.endswith(word, F.lit("ing")) & ~word.isin(NO_GERUNDS))
    return F.when(stays, s).otherwise(F.concat(made, rest))


def progressive(phrase: Column) -> Column:
    """Every verb phrase between commas, 'and' and 'then' as a gerund; what joins them stays."""
    joint = r"(?i)((?:\s*,\s*|\s+)(?:and|then)\s+|\s*,\s+)"
    # phrases and joints in turn, parted by a mark
    parts = F.split(F.regexp_replace(F.trim(phrase), joint, "\u0001$1\u0001"), "\u0001")
    return F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 0, gerund(p)).otherwise(p)), "")


def article(noun: Column) -> Column:
    return F.when(F.lower(noun).rlike("^[aeiou]"), F.lit("an")).otherwise(F.lit("a"))


def listing(items: Column) -> Column:
    """'a', 'a and b', 'a, b, and c'."""
    n = F.size(items)
    return F.when(n <= 2, F.array_join(items, " and ")).otherwise(F.concat(F.array_join(F.slice(items, F.lit(1), n - 1), ", "), F.lit(", and "), F.element_at(items, -1)))


def relation_sentence(relation: Column, objects: Column, truth: Column) -> Column:
    """A sentence of a spatial relation among objects; a false one is negated, one object alone is 'in place'."""
    plain = F.replace(F.trim(relation), F.lit("_"), F.lit(" "))
    phrase = F.when(plain == "contacting", "in contact with").when(plain == "relative to", "positioned relative to").otherwise(plain)
    verb = F.when(F.coalesce(truth, F.lit(True)), F.lit("is")).otherwise(F.lit("is not"))
    rest = F.slice(objects, F.lit(2), F.greatest(F.lit(1), F.size(objects) - 1))
    return F.when(F.size(objects) == 0, F.lit("")).when(F.size(objects) == 1, F.concat_ws(" ", F.lit("The"), objects[0], verb, F.lit("in place."))).otherwise(
        F.concat(F.concat_ws(" ", F.lit("The"), F.get(objects, F.lit(0)), verb, phrase, F.lit("the")), F.lit(" "), listing(rest), F.lit("."))
    )


def truth_of(text: Column) -> Column:
    """True or false of common words for it; null of others."""
    low = F.lower(F.trim(text))
    return F.when(low.isin("true", "yes", "1", "y"), F.lit(True)).when(low.isin("false", "no", "0", "n"), F.lit(False))


def _ascii(text: "str | None") -> "str | None":
    if text is None:
        return None
    s = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode().strip().lower()
    s = re.sub(r"_+", "_", re.sub(r"[^a-z0-9_]+", "", re.sub(r"[-\s]+", "_", s))).strip("_")
    return f"obj_{s}" if s and not s[0].isalpha() else s


def _ascii_batches(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for t in texts:
        yield t.map(_ascii)


def ascii_name(text: Column) -> Column:
    """Lower-case ASCII name of words joined by underscores (Unicode decomposition has no built-in function)."""
    return F.pandas_udf(_ascii_batches, "string")(text)


def counterfactual_clause(question: Column) -> Column:
    """What is supposed, without the opening of the question."""
    s = F.regexp_replace(F.trim(question), r"(?i)^(?:what (?:if|would happen if|happens if|could happen if)|suppose(?: that)?|imagine(?: that)?|if|assuming(?: that)?)\s+", "")
    return F.regexp_replace(s, r"[?.]+\s*$", "")


def cleaned_outcome(text: Column, most: int = 4) -> Column:
    """The first sentences of an outcome, up to one that suggests a recovery."""
    pieces = F.split(F.regexp_replace(F.trim(text), r"([.!?])\s+", "$1\u0001"), "\u0001")
    stop = F.coalesce(F.array_position(F.transform(pieces, lambda p: F.lower(p).rlike(r"^(?:to (?:recover|fix)|the person (?:should|could|must)|instead,|recovery)")), True).cast("int"), F.lit(0))
    n = F.when(stop > 1, F.least(F.lit(most), stop - 1)).otherwise(F.lit(most))
    return F.array_join(F.slice(pieces, F.lit(1), n), " ")


def best_by_terms(points: Column, context: Column) -> Column:
    """The point that shares most terms with the context, the longer of equals, the first of equally long ones."""
    from quern.functions.text import terms

    score = lambda own: F.transform(points, lambda p, i: F.struct((F.lit(10) * F.size(F.array_intersect(terms(p), own)) + F.size(F.split(p, " "))).alias("s"), (-i).alias("i"), p.alias("p")))
    return let(terms(context), lambda own: F.array_max(score(own))["p"])


# Words before the verb of a goal, words that are no verbs, verbs of two kinds of work.
BEFORE_VERB = ["to", "the", "a", "an", "this", "that", "these", "those", "after", "before", "while", "once", "then", "also", "first", "next", "finally", "further", "immediately"]
NOT_A_VERB = ["person", "item", "object", "camera", "it", "they", "he", "she", "one", "each", "all", "some", "any", "remaining", "several", "both", "other"]
WORK = {
    "prepare": ["stir", "pour", "mix", "bake", "fry", "grate", "rinse", "squeeze", "serve", "plate", "peel", "dice"],
    "organize": ["sort", "arrange", "clear", "gather", "collect"],
}
VAGUE = {
    "none": ["Go on with what is needed.", "Do the next thing.", "See to it as things stand."],
    "handle": ["Go on with this step.", "Handle the things at hand.", "Do with the items what is needed."],
    "prepare": ["Go on preparing.", "Get the things ready.", "Prepare the items as needed."],
    "organize": ["Go on tidying.", "Put the things in order.", "Arrange the items as needed."],
}


def _ing(verb: str) -> str:
    """The gerund of a plain verb, by the rule of `gerund`."""
    if verb.endswith("e") and not verb.endswith("ee"):
        return verb[:-1] + "ing"
    double = 3 <= len(verb) <= 5 and re.search("[^aeiou][aeiou][^aeiouwxy]$", verb) and verb not in NO_DOUBLING
    return verb + (verb[-1] if double else "") + "ing"


def vague_goal(goal: Column) -> Column:
    """A goal of the same kind of work that says nothing of it; which of them, a hash of the goal picks.

    The verb is the first word after articles, words of time and adverbs, plain or as a gerund.
    """
    from quern.functions.text import literal_array, template_pick, words

    bare = F.transform(words(F.lower(F.coalesce(goal, F.lit("")))), lambda w: F.regexp_replace(w, "[,.:;]+$", ""))
    verb = F.coalesce(F.get(F.filter(bare, lambda w: ~w.isin(BEFORE_VERB) & ~(F.endswith(w, F.lit("ly")) & (F.length(w) > 3))), F.lit(0)), F.lit(""))

    def kind(v: Column) -> Column:
        out = F.when(v.isin(*NOT_A_VERB) | (F.length(v) <= 1), F.lit("none"))
        for name, verbs in WORK.items():
            out = out.when(v.isin(*verbs, *map(_ing, verbs)), F.lit(name))
        return out.otherwise(F.lit("handle"))

    def made(k: Column) -> Column:
        out = F.lit("")
        for name, texts in VAGUE.items():
            out = F.when(k == name, F.element_at(literal_array(texts), (template_pick(len(texts), F.lit("vague"), goal) + 1).cast("int"))).otherwise(out)
        return out

    return let(let(verb, kind), made)


# States and directions that names of things do not begin or end with.
STATE_STARTS = ["ready_to_", "partially_", "more_", "less_", "switched_"]
STATE_ENDS = ["_on", "_off", "_open", "_closed", "_pressed", "_depressed"]
GENERIC_OBJECTS = ["hand", "hands", "left_hand", "right_hand", "object", "objects", "item", "items", "tool", "tools", "person"]


def key_objects(patients: Column, tokens: Column, agents: Column, affordances: Column, excluded: list[str] | None = None, most: int = 12) -> Column:
    """Names of the things of a plan: its patients and tokens that look like things, sorted, `most` at most, without names inside longer ones.

    Agents that are no patients, affordances, generic names and `excluded` words are none; nor are states,
    and single words count only as patients.
    """
    from quern.functions.text import longest_objects

    low = lambda xs: F.transform(xs, lambda x: F.lower(F.trim(x)))
    no = [*GENERIC_OBJECTS, *(excluded or [])]

    def fits(own: Column, x: Column) -> Column:
        k = F.lower(x)
        ok = ~k.isin(no) & ~F.array_contains(low(affordances), k) & x.rlike("^[A-Za-z][A-Za-z0-9_ ]*$")
        ok = ok & ~k.rlike("^(?:" + "|".join(STATE_STARTS) + ")") & ~k.rlike("(?:" + "|".join(STATE_ENDS) + ")$")
        named = F.array_contains(own, k)
        return ok & (named | (~F.array_contains(low(agents), k) & x.rlike("[_ ]")))

    every = F.array_distinct(F.transform(F.concat(patients, tokens), lambda x: F.trim(x)))
    kept = let(low(patients), lambda own: F.filter(every, lambda x: fits(own, x)))
    return longest_objects(F.slice(F.array_sort(kept), F.lit(1), F.lit(most)))
