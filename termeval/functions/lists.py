"""Precision, recall and F-score of array columns.

For one row's own lists, such as the top k retrieved names. Lists that come as
rows and may be of any length are scored by ``operators.list_scores`` instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column, on_undefined: str = "null") -> Column:
    """Division that is NULL, or fails the job, for a zero denominator."""
    if on_undefined == "null":
        return F.try_divide(numerator, denominator).cast("double")
    if on_undefined == "error":
        return (
            F.when(
                denominator == 0, F.raise_error(F.lit("score undefined: division by zero"))
            )
            .otherwise(F.try_divide(numerator, denominator))
            .cast("double")
        )
    raise ValueError("on_undefined must be 'null' or 'error'")


def hit_count(predicted: Column, relevant: Column) -> Column:
    """Number of predicted items that are relevant; duplicates count each time."""
    found = F.filter(
        predicted, lambda x: F.coalesce(F.array_contains(relevant, x), F.lit(False))
    )
    return F.size(found)


def precision(predicted: Column, relevant: Column, on_undefined: str = "null") -> Column:
    return _known(
        predicted,
        relevant,
        ratio(hit_count(predicted, relevant), F.size(predicted), on_undefined),
    )


def recall(predicted: Column, relevant: Column, on_undefined: str = "null") -> Column:
    return _known(
        predicted,
        relevant,
        ratio(hit_count(predicted, relevant), F.size(relevant), on_undefined),
    )


def f_score_of(p: Column, r: Column, beta: float, on_undefined: str = "null") -> Column:
    """F-score of a precision and a recall; undefined where both are zero."""
    squared = float(beta) ** 2
    return ratio(F.lit(1 + squared) * (p * r), F.lit(squared) * p + r, on_undefined)


def f_score(
    predicted: Column, relevant: Column, beta: float, on_undefined: str = "null"
) -> Column:
    return f_score_of(
        precision(predicted, relevant, on_undefined),
        recall(predicted, relevant, on_undefined),
        beta,
        on_undefined,
    )


def _known(predicted: Column, relevant: Column, score: Column) -> Column:
    """NULL lists give NULL, not the -1 that ``size`` may report."""
    return F.when(predicted.isNotNull() & relevant.isNotNull(), score)
