"""Rounding and vector arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int = 0) -> Column:
    """floor(x * 10^digits + 0.5) / 10^digits on doubles: halves go up, also below zero."""
    scale = float(10**digits)
    return F.floor(x.cast("double") * scale + 0.5) / scale


def clamp(x: Column, low: Column, high: Column) -> Column:
    """x between low and high; null stays null."""
    return F.when(x.isNotNull(), F.greatest(low, F.least(high, x)))


def dot(a: Column, b: Column) -> Column:
    """The inner product of two arrays, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """The cosine of the angle between two arrays; null where one has no length."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))
