"""Operators on question-answer rows: normalise, judge, rank, join, summarise, convert, audit."""
