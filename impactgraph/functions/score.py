"""Confidence of a path, factor by factor in a fixed order: one rule for numbers and for Column expressions."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

# Factors and thresholds.
DEPTH, DYNAMIC, INHERITANCE, AMBIGUOUS, DECORATED = 0.90, 0.40, 0.95, 0.60, 0.90
FAN_OUT = ((10, 0.65), (6, 0.80), (3, 0.90))
SYMBOL_CERTAINTIES = (0.98, 0.95, 0.90, 0.85)
AMBIGUOUS_CERTAINTY = 0.60
HIGH, MEDIUM = 0.85, 0.55

# What is said of each factor, in brief and in full, in the order of the factors.
TEXTS = {
    "direct": ("direct invocation", "The target is directly invoked by the test."),
    "hops": ("{depth}-hop depth", "Traversed a transitive path of {depth} hops (depth penalty: ×{factor:.2f})."),
    "dynamic": ("dynamic dispatch", "Traversed one or more dynamic call sites (getattr, eval, partial, exec, or runtime dispatch)."),
    "inherited": ("class inheritance", "Resolved method call via class hierarchy MRO traversal."),
    "symbols": ("weak symbol resolution", "Traversed symbols resolved via local annotations or inferences (average: {factor:.2f})."),
    "ambiguous": ("ambiguous resolution", "Encountered name-based resolution fallback due to multiple matching symbols in the codebase."),
    "edge": ("edge certainty {percent}%", "Traversed at least one edge with low resolution certainty ({percent}%)."),
    "decorated": ("decorated hop", "Traversed decorated function wrappers in the call path."),
    "fan_out": ("{level} fan-out ({fan_out})", "Encountered {level} branch ambiguity with {fan_out} call targets."),
}
FAN_OUT_LEVELS = {10: "very high", 6: "high", 3: "moderate"}
SUMMARIES = ("Direct invocation from the test node (factors: {reason}).", "Transitive path of depth {depth} (factors: {reason}).")
WEAK_SYMBOLS = 0.90


def plain(condition: bool, yes: Any, no: Any) -> Any:
    return yes if condition else no


def column(condition: Column, yes: Any, no: Any) -> Column:
    return F.when(condition, yes).otherwise(no)


def fan_out_factor(fan_out: Any, pick: Callable = column) -> Any:
    out = 1.0
    for least, factor in reversed(FAN_OUT):
        out = pick(fan_out >= least, factor, out)
    return out


def factors(depth: Any, dynamic: Any, inheritance: Any, symbol_mean: Any, ambiguous: Any, least: Any, decorated: Any, fan_out: Any, pick: Callable = column) -> list[tuple[str, Any]]:
    """(name, factor) of all that bears on a score, in order, 1 where something does not; pick chooses by a condition.

    symbol_mean and least are 1 where no edge has one.
    """
    return [
        ("hops", pick(depth >= 2, DEPTH ** (depth - 1), 1.0)),
        ("dynamic", pick(dynamic, DYNAMIC, 1.0)),
        ("inherited", pick(inheritance, INHERITANCE, 1.0)),
        ("symbols", symbol_mean),
        ("ambiguous", pick(ambiguous, AMBIGUOUS, 1.0)),
        ("edge", least),
        ("decorated", pick(decorated, DECORATED, 1.0)),
        ("fan_out", fan_out_factor(fan_out, pick)),
    ]


def confidence(*state: Any, pick: Callable = column) -> Any:
    """The product of all factors, not rounded."""
    value: Any = 1.0
    for _, factor in factors(*state, pick=pick):
        value = factor * value
    return value


def label(score: Any, pick: Callable = column) -> Any:
    return pick(score >= HIGH, "HIGH", pick(score >= MEDIUM, "MEDIUM", "LOW"))
