"""Risk score, severity and wording helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MAX_SCORE = 10


def points(condition: Column, value: int) -> Column:
    return F.when(condition, value).otherwise(0)


def capped_score(*terms: Column) -> Column:
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return F.least(total, F.lit(MAX_SCORE)).cast("int")


def severity(score: Column) -> Column:
    return F.when(score >= 9, "critical").when(score >= 7, "high").when(score >= 4, "medium").otherwise("low")


def finding_key(rule: Column, subject_type: Column, subject_id: Column) -> Column:
    return F.concat_ws(":", rule, subject_type, subject_id.cast("string"))


def percent(ratio: Column) -> Column:
    """Whole percent, ties to even."""
    return F.concat(F.bround(ratio * 100, 0).cast("int").cast("string"), F.lit("%"))
