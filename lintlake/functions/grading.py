"""Severities, penalties and grades as native column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ranks, weights and grade bounds of the scoring model.
SEVERITY_RANK = {"advisory": 1, "warning": 2, "error": 3}
SEVERITY_WEIGHT = {"advisory": 1.0, "warning": 4.0, "error": 12.0}
CONFIDENCE_WEIGHT = {"low": 0.5, "medium": 0.75, "high": 1.0}
GRADES = (("A", 90), ("B", 80), ("C", 70), ("D", 60))
CORRELATED_RULES = ("size.function-length", "complexity.cyclomatic", "complexity.cognitive", "complexity.nesting-depth", "size.parameter-count")
PILLARS = ("size", "complexity", "maintainability", "dead-code", "naming", "documentation", "security", "sensitive-data", "test-quality", "design")
PILLAR_FACTOR, FILE_FACTOR = 4, 5
CC_BUCKETS = (("1-5", 5), ("6-10", 10), ("11-15", 15), ("16-20", 20))


def lookup(values: dict, key: Column) -> Column:
    """The value of a small fixed mapping."""
    return F.create_map([F.lit(x) for x in chain(*values.items())])[key]


def severity_rank(column: str = "severity") -> Column:
    return lookup(SEVERITY_RANK, F.col(column))


def base_penalty() -> Column:
    """Weight of the severity by that of the confidence."""
    return lookup(SEVERITY_WEIGHT, F.col("severity")) * lookup(CONFIDENCE_WEIGHT, F.col("confidence"))


def clamped_score(penalty: Column, factor: int) -> Column:
    """100 less the weighted penalties, two decimals, within 0 and 100."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round(F.lit(100.0) - factor * penalty, 2)))


def grade(score: Column) -> Column:
    out = F.lit("F")
    for letter, least in reversed(GRADES):
        out = F.when(score >= least, letter).otherwise(out)
    return out


def cc_bucket(value: Column) -> Column:
    out = F.lit("21+")
    for name, most in reversed(CC_BUCKETS):
        out = F.when(value <= most, name).otherwise(out)
    return out
