"""Text metrics and normalisers as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that a reward ignores.
REWARD_STOPWORDS = [
    "a", "an", "and", "are", "as", "at", "be", "because", "been", "being", "by", "can", "could", "do", "does",
    "during", "for", "from", "had", "has", "have", "if", "in", "into", "is", "it", "its", "of", "on", "or",
    "that", "the", "their", "then", "this", "to", "while", "will", "with", "would",
]
# Words that a set of terms ignores.
TERM_STOPWORDS = [
    "the", "a", "an", "and", "or", "to", "of", "in", "on", "at", "is", "are", "be", "by", "for", "with",
    "then", "into", "from", "that", "this", "it", "as", "after", "before", "when", "while",
]
REWARD_TOKEN = r"[a-z0-9]+(?:[-'][a-z0-9]+)?"
# Fixed value: the forms of headings that traces are rid of; other lines must stay as they are.
HEADING = r"(?m)^(?:(?:PARAGRAPH\s*[0-9]+\s*[—–\-]\s*)|(?:[A-Z][A-Z\s]{2,30}:\s*)|(?:[A-Z][A-Z\s]{2,30}[—–\-]\s*))"


def let(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x), with x worked out once."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def literal_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def first_text(*values: Column) -> Column:
    """First value that is not blank, trimmed; empty if none is."""
    return F.coalesce(*[F.nullif(F.trim(v), F.lit("")) for v in values], F.lit(""))


def words(text: Column) -> Column:
    """Runs without white space, in order."""
    return F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))


def reward_tokens(text: Column) -> Column:
    """Distinct lower-case tokens of two characters or more that are no stopwords."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(REWARD_TOKEN), F.lit(0))
    return F.array_except(F.filter(F.array_distinct(found), lambda t: F.length(t) > 1), literal_array(REWARD_STOPWORDS))


def share(part: Column, whole: Column) -> Column:
    """part / whole as doubles; 0 where the whole is 0."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(0.0))


def token_recall(pred: Column, gold: Column) -> Column:
    """Share of gold's token set that pred's holds. Arguments are token sets."""
    return let(gold, lambda g: share(F.size(F.array_intersect(pred, g)), F.size(g)))


def token_f1(pred: Column, gold: Column) -> Column:
    both = F.struct(pred.alias("p"), gold.alias("g"))
    rates = let(both, lambda x: F.struct(token_recall(x["g"], x["p"]).alias("p"), token_recall(x["p"], x["g"]).alias("r")))
    return let(rates, lambda x: F.when(x["p"] + x["r"] == 0, F.lit(0.0)).otherwise(F.lit(2.0) * x["p"] * x["r"] / (x["p"] + x["r"])))


def terms(text: Column, generic: list[str] | None = None) -> Column:
    """Distinct words of three characters or more, hyphens split, without stopwords and generic objects."""
    found = F.regexp_extract_all(F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("-"), F.lit(" ")), F.lit("[A-Za-z0-9_]+"), F.lit(0))
    return F.array_except(F.filter(F.array_distinct(found), lambda t: F.length(t) >= 3), literal_array(TERM_STOPWORDS + (generic or [])))


def jaccard(a: Column, b: Column) -> Column:
    return share(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def overlap_coefficient(a: Column, b: Column) -> Column:
    return share(F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b)))


def ngrams(tokens: Column, n: int) -> Column:
    """Distinct n-grams of a word array, space-joined; empty if it is shorter."""
    grams = lambda w: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " ")))
    return let(tokens, lambda w: F.when(F.size(w) >= n, grams(w)).otherwise(F.array().cast("array<string>")))


def novelty(trace: Column, answer: Column, n: int = 4) -> Column:
    """1 - share of the trace's n-grams that stand in the answer; 0 for a trace without any."""
    both = F.struct(ngrams(words(F.lower(trace)), n).alias("t"), ngrams(words(F.lower(answer)), n).alias("a"))
    return let(both, lambda g: F.when(F.size(g["t"]) == 0, F.lit(0.0)).otherwise(F.lit(1.0) - share(F.size(F.array_intersect(g["t"], g["a"])), F.size(g["t"]))))


def half_repetition(trace: Column, n: int = 4) -> Column:
    """Share of the second half's n-grams that stand in the first half; 0 under 20 words."""

    def halves(w: Column) -> Column:
        mid = F.floor(F.size(w) / 2).cast("int")
        second = ngrams(F.slice(w, mid + 1, F.size(w) - mid), n)
        return F.when(F.size(w) >= 20, let(second, lambda g: share(F.size(F.array_intersect(ngrams(F.slice(w, F.lit(1), mid), n), g)), F.size(g)))).otherwise(F.lit(0.0))

    return let(words(F.lower(trace)), halves)


def sentences(text: Column, longer_than: int) -> Column:
    """Pieces that end at . ! or ? before white space, trimmed, if longer than the bound."""
    marked = F.regexp_replace(F.trim(text), r"([.!?])\s+", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda s: F.trim(s)), lambda s: F.length(s) > longer_than)


def sentence_repetition(text: Column, threshold: float = 0.3) -> Column:
    """Share of sentence pairs at least two apart whose word trigrams have a Jaccard index over the threshold.

    Quadratic in the sentences of one text, in one row: for tables of long texts take
    `operators.resolve.sentence_repetition`, whose sentences meet by trigrams.
    """
    grams = F.transform(sentences(text, 15), lambda s: ngrams(words(F.lower(s)), 3))

    def rate(g: Column) -> Column:
        def after(i: Column) -> Column:
            own = F.get(g, i)
            others = F.filter(F.slice(g, i + 3, F.size(g)), lambda o: (F.size(o) > 0) & (F.size(own) > 0))
            return F.struct(F.size(others).alias("n"), F.size(F.filter(others, lambda o: jaccard(own, o) > threshold)).alias("hits"))

        none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("hits"))
        total = F.aggregate(F.transform(F.sequence(F.lit(0), F.size(g) - 3), after), none, lambda a, x: F.struct((a["n"] + x["n"]).alias("n"), (a["hits"] + x["hits"]).alias("hits")))
        return let(total, lambda t: share(t["hits"], t["n"]))

    return let(grams, lambda g: F.when(F.size(g) >= 4, rate(g)).otherwise(F.lit(0.0)))


def strip_marks(word: Column, marks: str = ".,;:!?()[]") -> Column:
    return F.btrim(word, F.lit(marks))


def indicator_density(text: Column, indicators: list[str]) -> Column:
    """Share of words (without marks, lower case) that are reasoning words."""
    own = F.transform(words(F.lower(text)), lambda w: strip_marks(w))
    return let(own, lambda w: share(F.size(F.filter(w, lambda x: x.isin(indicators))), F.size(w)))


def any_of(text: Column, needles: list[str]) -> Column:
    """True if the text holds one of the strings."""
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(text, F.lit(n))
    return out


def numbered_points(block: Column) -> Column:
    """Lines of a block without bullets, numbers and blanks; the block itself if nothing else is left."""
    raw = F.trim(F.replace(F.coalesce(block, F.lit("")), F.lit("\\n"), F.lit("\n")))
    lines = F.transform(F.split(raw, "\r?\n"), lambda x: F.trim(F.regexp_replace(F.trim(F.regexp_replace(x, r"^\s*[-*•]\s*", "")), r"^\s*[0-9]+\s*[.)、]\s*", "")))
    kept = F.filter(lines, lambda x: x != "")
    return F.when(raw == "", F.array().cast("array<string>")).when(F.size(kept) == 0, F.array(raw)).otherwise(kept)


def stripped_headings(text: Column) -> Column:
    """Text without heading artefacts at line starts (three passes), runs of blank lines shortened."""
    for _ in range(3):
        text = F.regexp_replace(text, HEADING, "")
    return F.trim(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def snake_tokens(text: Column) -> Column:
    """Distinct lower-case words joined by underscores, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\b"), F.lit(0)))


def quoted(text: Column) -> Column:
    """What stands between double quotes."""
    return F.regexp_extract_all(text, F.lit(r'"([^"]+)"'), F.lit(1))


def ended(text: Column) -> Column:
    """One closing mark at the end; a full stop if there is none."""
    s = F.regexp_replace(F.regexp_replace(F.trim(text), r"\s+([.!?])$", "$1"), r"([.!?])[.!?]+$", "$1")
    return F.when((s == "") | s.rlike("[.!?][\"’”)]*$"), s).otherwise(F.concat(s, F.lit(".")))


def shortened_goal(goal: Column, most: int = 20) -> Column:
    """A goal cut at ', then', and at the last comma inside the first words if it is long."""
    head = F.regexp_replace(F.trim(goal), r"(?i),?\s+then\b.*$", "")

    def cut(w: Column) -> Column:
        part = F.array_join(F.slice(w, F.lit(1), F.lit(most)), " ")
        before = F.regexp_replace(part, r",[^,]*$", "")
        return F.when(F.size(w) <= most, head).when((F.size(words(before)) >= 4) & F.contains(part, F.lit(",")), before).otherwise(part)

    return let(words(head), cut)


def file_slug(text: Column, most: int = 80) -> Column:
    """Lower-case name of letters, digits and underscores, cut at an underscore past the middle."""
    s = F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), F.lit("_"))
    cut = F.substring(s, 1, most)
    back = F.regexp_replace(cut, "_[^_]*$", "")
    return F.when(F.length(s) <= most, s).when(F.length(back) > most // 2, back).otherwise(F.btrim(cut, F.lit("_")))


def keep_first(items: Column, most: float = 0.8) -> Column:
    """Sentences of which at most a share of words stands in one earlier kept sentence."""
    return F.aggregate(
        F.array_distinct(items),
        F.array().cast("array<string>"),
        lambda kept, s: F.when(
            F.exists(kept, lambda k: share(F.size(F.array_intersect(F.array_distinct(words(F.lower(s))), words(F.lower(k)))), F.greatest(F.lit(1), F.size(F.array_distinct(words(F.lower(s)))))) > most), kept
        ).otherwise(F.concat(kept, F.array(s))),
    )


def longest_objects(items: Column) -> Column:
    """Names that do not stand, word-bounded, in a longer one of the array."""
    return F.filter(items, lambda a: ~F.exists(items, lambda b: (F.length(b) > F.length(a)) & F.contains(F.concat(F.lit(" "), b, F.lit(" ")), F.concat(F.lit(" "), a, F.lit(" ")))))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common beginning."""
    return F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length(a), F.length(b)))),
        F.lit(0),
        lambda n, i: F.when((n == i - 1) & (F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))) & (F.substring(a, i, F.lit(1)) != ""), i).otherwise(n),
    )


def same_root(a: Column, b: Column) -> Column:
    """Equal, or a common beginning of 5 letters and of 60 % of the shorter with endings of at most 4."""
    n, short, long_ = common_prefix(a, b), F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    return (a == b) | ((n >= 5) & (n >= F.lit(0.6) * short) & (long_ - n <= 4))


def root_overlap(a: Column, b: Column) -> Column:
    """How many terms of a have one of the same root in b."""
    return F.size(F.filter(a, lambda x: F.exists(b, lambda y: same_root(x, y))))


def span_present(span: Column, text: Column, relaxed: bool = True) -> Column:
    """The span stands in the text, or (relaxed) enough of its terms have one of the same root there.

    Two terms or fewer: all; up to four: all but one; more: half, rounded up; never more than 25.
    """
    exact = F.contains(F.lower(text), F.lower(F.trim(span)))
    if not relaxed:
        return exact

    def enough(t: Column) -> Column:
        n = F.size(t)
        need = F.when(n <= 2, n).when(n <= 4, n - 1).otherwise(F.least(F.lit(25), F.ceil(n / 2).cast("int")))
        return (n > 0) & (let(terms(text), lambda own: root_overlap(t, own)) >= need)

    return exact | let(terms(span), enough)


def template_pick(n: int, *parts: Column) -> Column:
    """Stable number below n: the first 48 bits of the md5 of the parts joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 12), 16, 10).cast("long") % F.lit(n)


def uid(*parts: Column) -> Column:
    """sha-1 of the trimmed parts, one in each line."""
    return F.sha1(F.concat_ws("\n", *[F.trim(F.coalesce(p.cast("string"), F.lit(""))) for p in parts]))


def uniform_index(n: Column, k: Column) -> Column:
    """k indices spread over 0 ... n - 1, rounded half to even; all of them if there are not more."""
    return F.when(n <= k, F.sequence(F.lit(0), n - 1)).when(k <= 1, F.array(F.lit(0))).otherwise(
        F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.bround(i * (n - 1) / (k - 1)).cast("int"))
    )
