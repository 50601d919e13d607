"""Acceptance of rewritten answers, and the cascade from rewrite to draft."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.leak import has_leak
from quern.functions.text import any_of, jaccard, quoted, snake_tokens, span_present, terms, words

BANNED = ["as an ai", "in this scenario", "it is important to note", "the provided draft", "according to the draft", "rewritten answer"]


def problems(rewrite: Column, draft: Column, question: Column, spans: Column, distractors: Column, least: int = 10, growth: float = 2.5, fresh: float = 0.5) -> Column:
    """Codes of what is wrong with a rewrite, in order; empty if it is accepted.

    It must have some length but not too much, no frame names, no copy of the question, every
    required span by the relaxed rule, the draft's snake-case and quoted parts, no distractor, few
    words that the draft has not, and no banned phrase.
    """
    own, base = terms(rewrite), terms(draft)
    new = F.size(F.array_except(own, base)) / F.greatest(F.lit(1), F.size(own))
    checks = [
        ("too_short", F.length(F.trim(rewrite)) < least),
        ("leak", has_leak(rewrite)),
        ("echo", jaccard(terms(rewrite), terms(question)) > 0.8),
        ("missing_span", F.exists(spans, lambda s: ~span_present(s, rewrite))),
        ("missing_token", F.size(F.array_except(snake_tokens(draft), snake_tokens(rewrite))) > 0),
        ("missing_quote", F.exists(quoted(draft), lambda q: ~F.contains(rewrite, q))),
        ("distractor", F.exists(distractors, lambda d: F.contains(F.lower(rewrite), F.lower(d)))),
        ("novel_words", new > fresh),
        ("too_long", F.size(words(rewrite)) > growth * F.size(words(draft)) + 12),
        ("banned", any_of(F.lower(rewrite), BANNED)),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks]))


def chosen(direct: Column, polished: Column, draft: Column, ok_direct: Column, ok_polished: Column, mode: str = "draft") -> Column:
    """The first accepted of the direct and the polished rewrite; else the draft, null ('skip') or an error ('fail')."""
    last = {"draft": draft, "skip": F.lit(None).cast("string"), "fail": F.raise_error(F.lit("no rewrite was accepted")).cast("string")}[mode]
    return F.when(ok_direct, direct).when(ok_polished, polished).otherwise(last)


def scrubbed(text: Column) -> Column:
    """Text without banned phrases, blanks put right."""
    for b in BANNED:
        text = F.regexp_replace(text, f"(?i)\\b{b}\\b,?\\s*", "")
    return F.trim(F.regexp_replace(text, r"\s{2,}", " "))
