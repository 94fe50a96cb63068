"""Ordered rule tables as expressions: the first matching pattern decides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_match(text: Column, rules: Sequence[tuple[str, str]], default: str | None) -> Column:
    """rules are (label, pattern); patterns are Java regular expressions, searched anywhere."""
    out: Column | None = None
    for label, pattern in rules:
        test = text.rlike(pattern)
        out = F.when(test, label) if out is None else out.when(test, label)
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def all_matches(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Array of the labels of all matching patterns, in rule order."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), label) for label, p in rules]))
