"""Number helpers shared by every operator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(c, digits=0) -> Column:
    """Nearest value, ties toward plus infinity (not Spark's half away from zero)."""
    c = F.col(c) if isinstance(c, str) else c
    if digits == 0:
        return F.floor(c + F.lit(0.5))
    k = float(10**digits)
    return F.floor(c * F.lit(k) + F.lit(0.5)) / F.lit(k)


def clamp(v: Column, lo, hi) -> Column:
    """Low bound first: when the bounds cross, the low side is tested before the high."""
    lo = lo if isinstance(lo, Column) else F.lit(lo)
    hi = hi if isinstance(hi, Column) else F.lit(hi)
    return F.when(v < lo, lo).when(v > hi, hi).otherwise(v)


def number_text(c: Column) -> Column:
    """Two decimals at most, trailing zeros dropped: 12.5, 3, -0.07."""
    n = F.floor(c * F.lit(100.0) + F.lit(0.5)).cast("bigint")
    a = F.abs(n)
    whole = F.floor(a / 100).cast("bigint").cast("string")
    part = a % 100
    frac = (
        F.when(part == 0, F.lit(""))
        .when(part % 10 == 0, F.concat(F.lit("."), (part / 10).cast("int").cast("string")))
        .otherwise(F.concat(F.lit("."), F.lpad(part.cast("string"), 2, "0")))
    )
    return F.concat(F.when(n < 0, F.lit("-")).otherwise(F.lit("")), whole, frac)
