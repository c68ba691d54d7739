"""Rounding, exact sums and calendar arithmetic as Column expressions.

All helpers work on ``timestamp_ntz`` / ``date`` only, so results do not
depend on the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def round_half_away(col: Column | str, digits: int) -> Column:
    """ROUND(x, n) on the binary double: scale, round half away from zero, unscale.

    ``F.round(x, n)`` rounds the decimal rendering of ``x`` and disagrees with
    the reference engine on values such as 0.285 (0.29 vs 0.28).
    """
    col = _c(col)
    if digits == 0:
        return F.round(col.cast("double"), 0)
    scale = float(10 ** digits)
    return F.round(col.cast("double") * F.lit(scale), 0) / F.lit(scale)


def round_python(col: Column | str, digits: int) -> Column:
    """Python's ``round(x, n)`` of a double: half to even on the exact binary value.

    Only a product x * 10^n that lands exactly on a half can round wrongly, so
    its rounding error (exact, from x split into two halves of 26 bits) says on
    which side of the half the true value lies; a true half goes to even.
    """
    x, scale = _c(col).cast("double"), F.lit(float(10 ** digits))
    product = x * scale
    shifted = x * F.lit(float(2 ** 27 + 1))
    high = shifted - (shifted - x)
    error = (high * scale - product) + (x - high) * scale
    half = F.abs(product - F.rint(product)) == 0.5
    whole = (F.when(half & (error > 0), F.rint(product + F.lit(0.25)))
             .when(half & (error < 0), F.rint(product - F.lit(0.25)))
             .otherwise(F.rint(product)))
    return whole / scale


def round_stable(col: Column | str, digits: int) -> Column:
    """Round twice (6 digits, then ``digits``) so last-bit noise of
    interpolated percentiles or standard deviations cannot move the result."""
    return round_half_away(round_half_away(col, 6), digits)


def exact_sum(col: Column | str, scale: int = 2) -> Column:
    """Order-independent sum of a money/rounded column: sum as decimal, return double."""
    return F.sum(_c(col).cast(f"decimal(18,{scale})")).cast("double")


def exact_avg(col: Column | str, scale: int = 2) -> Column:
    """Order-independent mean: exact decimal sum divided by the non-null count."""
    col = _c(col)
    return F.try_divide(exact_sum(col, scale), F.count(col).cast("double"))


def ratio(num: Column | str, den: Column | str) -> Column:
    """num / NULLIF(den, 0) as double; NULL instead of an error on zero."""
    den = _c(den).cast("double")
    return _c(num).cast("double") / F.nullif(den, F.lit(0.0))


def day_diff(start: Column | str, end: Column | str) -> Column:
    """Number of day boundaries from start to end (DATEDIFF('day'))."""
    return F.datediff(F.to_date(_c(end)), F.to_date(_c(start))).cast("bigint")


def week_start(ts: Column | str) -> Column:
    """Monday 00:00 of the week of ``ts`` (DATE_TRUNC('week'))."""
    return F.trunc(F.to_date(_c(ts)), "week").cast("timestamp_ntz")


def month_start(ts: Column | str) -> Column:
    """First day of the month of ``ts`` at 00:00 (DATE_TRUNC('month'))."""
    return F.trunc(F.to_date(_c(ts)), "month").cast("timestamp_ntz")


def week_diff(start: Column | str, end: Column | str) -> Column:
    """DATEDIFF('week') as the reference engine computes it: day boundaries
    crossed, divided by 7 and truncated toward zero (Sunday -> Monday is 0,
    Monday -> next Monday is 1)."""
    days = F.datediff(F.to_date(_c(end)), F.to_date(_c(start)))
    return (days / F.lit(7)).cast("bigint")


def month_diff(start: Column | str, end: Column | str) -> Column:
    """Number of month boundaries crossed (DATEDIFF('month')): Jan 31 -> Feb 1 is 1."""
    start, end = _c(start), _c(end)
    return ((F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)).cast("bigint")


def day_of_week(ts: Column | str) -> Column:
    """EXTRACT(dow): Sunday = 0 ... Saturday = 6."""
    return (F.dayofweek(_c(ts)) - 1).cast("bigint")
