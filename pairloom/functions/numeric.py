"""Bounded integer arithmetic on columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: the largest bound a schedule may carry, a quarter of a quarter of the LONG range.
DISTANCE_CAP = (2**63 - 1) // 8
UNREACHABLE = (2**63 - 1) // 4


def element_or_zero(values: Column, index: Column) -> Column:
    """Zero-based array read; 0 outside the array."""
    return F.coalesce(F.try_element_at(values, (index + 1).cast("int")), F.lit(0).cast("long"))


def subtract_to_zero(a: Column, b: Column) -> Column:
    return F.greatest(a - b, F.lit(0).cast("long"))


def snap(x: Column) -> Column:
    """The nearest whole number when ``x`` is within rounding noise of it."""
    near = F.abs(x - F.round(x)) <= F.greatest(F.lit(1e-9), F.abs(x) * 1e-15)
    return F.when(near, F.round(x)).otherwise(x)


def ceil_to_distance(x: Column) -> Column:
    """Ceiling with snapping, 0 below zero, capped at ``DISTANCE_CAP``."""
    return (
        F.when(~(x > 0), F.lit(0).cast("long"))
        .when(x >= float(DISTANCE_CAP), F.lit(DISTANCE_CAP))
        .otherwise(F.ceil(snap(x)).cast("long"))
    )


def floor_to_distance(x: Column) -> Column:
    return (
        F.when(~(x > 0), F.lit(0).cast("long"))
        .when(x >= float(DISTANCE_CAP), F.lit(DISTANCE_CAP))
        .otherwise(F.floor(x).cast("long"))
    )


def scaled_ceiling(unit: Column, ratio: float) -> Column:
    """ceil(unit * ratio) with snapping; a non-positive unit or ratio is an error."""
    if not ratio > 0:
        raise ValueError("ratio must be positive")
    scaled = unit * F.lit(float(ratio))
    return F.when(
        (unit <= 0) | (scaled >= float(DISTANCE_CAP)), F.raise_error(F.lit("unit out of range")).cast("long")
    ).otherwise(F.ceil(snap(scaled)).cast("long"))


def above_threshold(threshold: Column, slack: int = 1) -> Column:
    """Smallest whole number strictly above ``threshold`` for slack 1."""
    return F.when(threshold >= float(DISTANCE_CAP), F.lit(DISTANCE_CAP)).otherwise(
        F.floor(threshold).cast("long") + max(1, slack)
    )


def level_exponent(x: Column) -> Column:
    """x ln x, 0 at 0."""
    return F.when(x == 0, 0.0).otherwise(x * F.log(x.cast("double")))


def add_saturating(a: Column, b: Column) -> Column:
    total = F.try_add(a, b)
    return F.when(total.isNull() | (total > UNREACHABLE), F.lit(UNREACHABLE)).otherwise(total)


def multiply_saturating(a: Column, b: Column) -> Column:
    product = F.try_multiply(a, b)
    return F.when(product.isNull() | (product > UNREACHABLE), F.lit(UNREACHABLE)).otherwise(product)
