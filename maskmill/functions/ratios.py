"""Overlap ratios from counts, with SQL NULL for what is undefined."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe(numerator, denominator) -> Column:
    """Quotient, NULL where the denominator is zero or NULL."""
    d = _c(denominator).cast("double")
    return F.when(d != 0, _c(numerator).cast("double") / d)


def dice(tp, fp, fn) -> Column:
    return safe(2 * _c(tp), 2 * _c(tp) + _c(fp) + _c(fn))


def iou(tp, fp, fn) -> Column:
    return safe(_c(tp), _c(tp) + _c(fp) + _c(fn))


def recall(tp, fn) -> Column:
    return safe(_c(tp), _c(tp) + _c(fn))


def precision(tp, fp, fn) -> Column:
    """Zero, not NULL, where nothing was predicted though something was there."""
    return F.when(_c(tp) + _c(fp) == 0, F.when(_c(fn) > 0, F.lit(0.0))).otherwise(safe(_c(tp), _c(tp) + _c(fp)))


def balanced_mean(*columns) -> Column:
    """Mean that is NULL as soon as one part is."""
    total = _c(columns[0])
    for c in columns[1:]:
        total = total + _c(c)
    return total / float(len(columns))
