"""Predicates on texts that mention frames, files or times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Forms of frame names, time stamps, files and paths that must not leak.
LEAK_PATTERNS = [
    r"(?i)\bframe_[0-9]+\b",
    r"(?i)\bsample_[0-9]+\b",
    r"(?i)\bkeyframe[_\s]?[0-9]+\b",
    r"(?i)\bstep_[0-9]+\b",
    r"(?i)\bclip_[0-9]+\b",
    r"(?i)\bsegment_[0-9]+\b",
    r"(?i)\bkf_[0-9]+\b",
    r"(?i)\bts_[0-9]",
    r"\b[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?\b",
    r"(?i)\.(jpg|jpeg|png|mp4|webm|gif)\b",
    r"(?i)\b(frame|image)\s*[0-9]+\b",
    r"(?i)(?:/[a-zA-Z_]\w*){3,}",
    r"(?i)\bP[0-9]+_[0-9]+",
]
FRAME_REFERENCE = r"(?i)\b(?:frame|image|picture|photo)s?\s*#?\s*[0-9]+\b"
TIME_REFERENCE = r"(?i)\b[0-9]+(?:\.[0-9]+)?\s*(?:s|sec|secs|second|seconds|ms|min|minutes?)\b|\b[0-9]{1,2}:[0-9]{2}\b"
PLACEHOLDERS = ["", "n/a", "na", "none", "null", "unknown", "unspecified", "tbd", "todo", "..."]


# One pattern, so that a text is worked out once however it came about.
ANY_LEAK = "|".join(f"(?i:{p[4:]})" if p.startswith("(?i)") else f"(?:{p})" for p in LEAK_PATTERNS)
# The same, quick on what leaks nothing: every form holds a digit, a slash or a file's ending, and begins with one of a few characters.
_QUICK_LEAK = rf"\A(?=[\s\S]*?(?:[0-9/]|\.[gjmpwGJMPW]))[\s\S]*?(?=[0-9./cfikpstCFIKPST])(?:{ANY_LEAK})"


def has_leak(text: Column) -> Column:
    return F.coalesce(text.rlike(_QUICK_LEAK), F.lit(False))


def has_time_reference(text: Column) -> Column:
    return F.coalesce(text.rlike(TIME_REFERENCE), F.lit(False))


def has_frame_reference(text: Column) -> Column:
    return F.coalesce(text.rlike(FRAME_REFERENCE), F.lit(False))


def is_placeholder(text: Column) -> Column:
    return F.lower(F.trim(F.coalesce(text, F.lit("")))).isin(PLACEHOLDERS)
