"""Saturating Q15 fixed point: integers in [-32768, 32767] that stand for value / 32768. Zero divisors are errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ONE, LOW, HIGH = 32768, -32768, 32767


def clamp(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(LOW)), F.lit(HIGH)).cast("long")


def quantise(x: Column) -> Column:
    """The nearest fixed-point value, halves away from zero, saturated."""
    return clamp(F.round(x * ONE, 0).cast("long"))


def to_double(q: Column) -> Column:
    return q / F.lit(float(ONE))


def add(a: Column, b: Column) -> Column:
    return clamp(a + b)


def sub(a: Column, b: Column) -> Column:
    return clamp(a - b)


def _div(a: Column, b: Column) -> Column:
    """Integer quotient, truncated toward zero."""
    return F.call_function("div", a, b)


def mul(a: Column, b: Column) -> Column:
    """(a b + 2**14) / 2**15 with truncation toward zero: biased for negative products, as specified."""
    return clamp(_div(a * b + 16384, F.lit(ONE).cast("long")))


def div(a: Column, b: Column) -> Column:
    """round(a 2**15 / b), halves away from zero."""
    n, d = F.abs(a) * ONE, F.abs(b)
    safe = F.when(d == 0, F.raise_error("q15 div: the divisor is zero").cast("long")).otherwise(d)
    q = _div(n + _div(safe, F.lit(2).cast("long")), safe)
    return clamp(F.when((a < 0) != (b < 0), -q).otherwise(q))


def sum_(q: Column) -> Column:
    return clamp(F.sum(q))


def mean(q: Column) -> Column:
    """The sum over the count, truncated toward zero."""
    return clamp(_div(F.sum(q), F.count(q)))


def max_(q: Column) -> Column:
    return F.max(q)


def min_(q: Column) -> Column:
    return F.min(q)
