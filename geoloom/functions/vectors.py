"""Column functions on array vectors and robust scalars."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

FLOOR = 1e-12


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def quartiles(value: Column) -> Column:
    """Exact linear-interpolated quartiles as an array of three."""
    return F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))


def floored(value: Column) -> Column:
    """At least 1e-12; null stays null."""
    return F.when(value.isNotNull(), F.greatest(value, F.lit(FLOOR)))


def robust_ratio(value: Column, median: Column, q75: Column) -> Column:
    """Distance from the median in right spreads."""
    return (value - median) / floored(q75 - median)


#: The ratio at which the open-space score is one half, and the width of its transition (ln 1.5).
LONG_RATIO, TRANSITION = 3.0, 0.4054651081


def open_space(length: Column, second: Column, ratio: float = LONG_RATIO, width: float = TRANSITION) -> Column:
    """Sigmoid of the log ratio of the second-longest other edge to the edge; 0 where there is no such edge or it has no length."""
    z = (F.ln(floored(second / floored(length))) - F.ln(F.lit(ratio))) / width
    return F.when(F.coalesce(second, F.lit(0.0)) <= 0, F.lit(0.0)).otherwise(1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-60.0)), F.lit(60.0)))))


def clipped(value: Column, low: float = 0.0, high: float = 2.0) -> Column:
    """Clip that keeps null."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))
