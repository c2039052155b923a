"""Exact decimal arithmetic with one rounding, half away from zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(num: Column, den: Column, scale: int, places: int) -> Column:
    """num / den rounded once to places decimals. num: decimal with scale decimals, den: whole number; null where den is null or 0.

    The division is done on whole numbers: half of the divisor is added before it.
    """
    up = num.cast(f"decimal(28,{scale})") * (2 * 10**places)
    whole = (F.abs(up) * 10**scale).cast("decimal(38,0)")
    d = F.nullif(den.cast("decimal(18,0)"), F.lit(0).cast("decimal(18,0)"))
    half = d * 10**scale
    quotient = F.call_function("div", whole + half, half * 2)
    return (F.sign(num) * quotient / F.lit(10.0**places)).cast(f"decimal(18,{places})")


def minutes(start: Column, end: Column) -> Column:
    """Minutes between two timestamps as decimal(10,2): rounded to hundredths before anything is compared with it."""
    micros = F.unix_micros(end) - F.unix_micros(start)
    hundredths = F.call_function("div", micros * 2 + 600_000, F.lit(1_200_000))
    return (hundredths / 100).cast("decimal(10,2)")
