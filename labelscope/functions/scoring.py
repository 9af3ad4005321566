"""Column expressions shared by the scoring, ensembling and cost code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = -1  # outside every label range [0, K)
VALIDATION_LABELS = 500


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_correct(y: str | Column, pred: str | Column) -> Column:
    """True only where a prediction exists and equals the truth; never null."""
    return F.coalesce(_c(y) == _c(pred), F.lit(False))


def or_missing(pred: str | Column) -> Column:
    """A missing prediction becomes the sentinel, so it scores as wrong and can be counted."""
    return F.coalesce(_c(pred), F.lit(MISSING))


def argmax(values: str | Column) -> Column:
    """0-based index of the largest element; the first one on ties."""
    return (F.array_position(_c(values), F.array_max(_c(values))) - 1).cast("bigint")


def f1(tp: str | Column, predicted: str | Column, true: str | Column) -> Column:
    """2tp / (predicted + true); 0 for a class absent from both."""
    denominator = _c(predicted) + _c(true)
    return F.when(denominator > 0, 2.0 * _c(tp) / denominator).otherwise(F.lit(0.0))


def label_budget(n: str | Column, validation: int = VALIDATION_LABELS, demos: int | Column = 0) -> Column:
    """Labels a budget really uses: training rows, the validation rows, and demonstrations."""
    extra = demos if isinstance(demos, Column) else F.lit(demos)
    return (_c(n) + F.lit(validation) + extra).cast("bigint")


def interval_verdict(lower: str | Column, upper: str | Column) -> Column:
    """Which system an interval on `a - b` favours."""
    return (
        F.when(_c(lower) > 0, F.lit("a_better"))
        .when(_c(upper) < 0, F.lit("b_better"))
        .otherwise(F.lit("not_significant"))
    )
