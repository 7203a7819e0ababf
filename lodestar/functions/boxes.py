"""Box algebra on (x0, y0, x1, y1) columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b[2] - b[0]) * F.greatest(F.lit(0.0), b[3] - b[1])


def intersection_area(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))


def padded(b: Column, by: float) -> Column:
    return F.array(b[0] - by, b[1] - by, b[2] + by, b[3] + by)


def union(a: Column, b: Column) -> Column:
    return F.array(F.least(a[0], b[0]), F.least(a[1], b[1]), F.greatest(a[2], b[2]), F.greatest(a[3], b[3]))


def clipped(b: Column, window: Column) -> Column:
    return F.array(F.greatest(b[0], window[0]), F.greatest(b[1], window[1]), F.least(b[2], window[2]), F.least(b[3], window[3]))


def covered(inner: Column, outer: Column, share: float = 0.6) -> Column:
    """Whether ``outer`` covers that share of ``inner``; never if ``inner`` has no area."""
    return F.coalesce((area(inner) > 0) & (intersection_area(inner, outer) >= area(inner) * share), F.lit(False))


def rounded(b: Column, digits: int = 2) -> Column:
    return F.transform(b, lambda x: F.bround(x, digits))
