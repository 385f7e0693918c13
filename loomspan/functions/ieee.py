"""Scalar kernels with IEEE results where ANSI SQL would raise or give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")

#: Comparison codes of masks and searches.
COMPARE = {
    0: lambda a, b: a > b,
    1: lambda a, b: a >= b,
    2: lambda a, b: a < b,
    3: lambda a, b: a <= b,
    4: lambda a, b: a == b,
    5: lambda a, b: a != b,
}


def ieee_div(x: Column, y: Column) -> Column:
    """x / y; by zero: infinities by sign, NaN for 0/0 and NaN/0."""
    safe = F.when(y == 0, F.lit(1.0)).otherwise(y)
    return F.when(y == 0, F.when((x == 0) | F.isnan(x), F.lit(NAN)).when(x > 0, F.lit(INF)).otherwise(F.lit(-INF))).otherwise(x / safe)


def _log(f, x: Column) -> Column:  # noqa: ANN001
    return F.when(x == 0, F.lit(-INF)).when(x < 0, F.lit(NAN)).otherwise(f(F.when(x > 0, x).otherwise(F.lit(1.0))))


def ieee_ln(x: Column) -> Column:
    return _log(F.ln, x)


def ieee_log2(x: Column) -> Column:
    return _log(F.log2, x)


def ieee_log10(x: Column) -> Column:
    return _log(F.log10, x)


def floored_mod(x: Column, y: Column) -> Column:
    """x - y * floor(x / y): the sign follows the divisor; a zero divisor is an error."""
    safe = F.when(y == 0, F.raise_error("mod: the divisor is zero").cast("double")).otherwise(y)
    return x - safe * F.floor(x / safe)


def is_inf(x: Column) -> Column:
    """True infinities only; large finite values are not."""
    return (x == F.lit(INF)) | (x == F.lit(-INF))


def half_away(x: Column) -> Column:
    """Rounded to an integer, halves away from zero."""
    return F.signum(x) * F.floor(F.abs(x) + 0.5)
