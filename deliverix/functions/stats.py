"""Statistics from exact integer sums, plus the Pearson p-value.

Float aggregates such as ``corr`` or ``regr_slope`` depend on the order in
which partial results are merged, so two engines (or two runs with a
different partitioning) can disagree in the last bits.  The inputs here are
already rounded to a known number of decimals, so they are scaled to
integers and all sums are exact; only the final division is floating point.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _scaled(col: Column, scale: int) -> Column:
    if scale:
        col = F.round(col.cast("double") * F.lit(float(10 ** scale)), 0)
    return col.cast("decimal(38,0)")


def exact_slope(x: Column, y: Column, y_scale: int) -> Column:
    """Least-squares slope of y on an integer x (aggregate expression)."""
    xi, yi = _scaled(x, 0), _scaled(y, y_scale)
    n = F.count(F.lit(1)).cast("decimal(38,0)")
    sx, sy = F.sum(xi), F.sum(yi)
    num = n * F.sum(xi * yi) - sx * sy
    den = n * F.sum(xi * xi) - sx * sx
    return F.try_divide(num.cast("double"), den.cast("double")) / F.lit(float(10 ** y_scale))


def exact_pearson_r(x: Column, y: Column, x_scale: int, y_scale: int) -> Column:
    """Pearson correlation of two rounded columns (aggregate expression).

    r is invariant to scaling, so x and y are used as the integers x*10^s.
    """
    xi, yi = _scaled(x, x_scale), _scaled(y, y_scale)
    n = F.count(F.lit(1)).cast("decimal(38,0)")
    sx, sy = F.sum(xi), F.sum(yi)
    num = (n * F.sum(xi * yi) - sx * sy).cast("double")
    dx = (n * F.sum(xi * xi) - sx * sx).cast("double")
    dy = (n * F.sum(yi * yi) - sy * sy).cast("double")
    return F.try_divide(num, F.sqrt(dx * dy))


def _gamma_ratio(a: Column) -> Column:
    """Gamma(a + 1/2) / Gamma(a) for a >= 1/2, to the last digits.

    By Gamma(x + 1) = x Gamma(x) the argument goes up by 32, where the first
    terms of the asymptotic series are enough.
    """
    product = F.aggregate(F.sequence(F.lit(0), F.lit(31)), F.lit(1.0),
                          lambda acc, i: acc * (a + i) / (a + i + F.lit(0.5)))
    z = F.lit(1.0) / (a + F.lit(32.0))
    series = F.lit(0.0)
    for c in reversed((1.0, -1 / 8, 1 / 128, 5 / 1024, -21 / 32768, -399 / 262144, 869 / 4194304, 39325 / 33554432)):
        series = series * z + F.lit(c)
    return product * F.sqrt(a + F.lit(32.0)) * series


def _beta_fraction(a: Column, b: Column, x: Column, terms: Column) -> Column:
    """The continued fraction of the incomplete beta function, from its last term up."""
    def step(v: Column, k: Column) -> Column:
        m = F.floor(k / 2).cast("double")
        even = m * (b - m) * x / ((a + m * 2 - 1) * (a + m * 2))
        odd = -(a + m) * (a + b + m) * x / ((a + m * 2) * (a + m * 2 + 1))
        return F.lit(1.0) + F.when(k % 2 == 0, even).otherwise(odd) / v

    return F.lit(1.0) / F.aggregate(F.sequence(terms, F.lit(1), F.lit(-1)), F.lit(1.0), step)


def significant(value: Column, digits: int = 12) -> Column:
    """``value`` rounded to its first digits, whatever its size."""
    return F.format_string(f"%.{digits - 1}e", value).cast("double")


def student_t_pvalue(r: Column, n: Column) -> Column:
    """Two-sided p-value of a Pearson r from n pairs, as a JVM expression.

    With nu = n - 2 degrees of freedom it is the incomplete beta function I(1 -
    r^2; nu/2, 1/2), by its continued fraction where that converges fast and as
    one minus the mirrored one elsewhere; the number of terms grows with the
    root of nu.  The accuracy is relative (about 1e-13), so that tails far
    below the rounding of a double near one keep their digits; the result has 12
    significant digits, which hides the last bits of math libraries.
    """
    nu = (n - F.lit(2)).cast("double")
    a, half, ar = nu / 2, F.lit(0.5), F.abs(r)
    x = (F.lit(1.0) - ar) * (F.lit(1.0) + ar)
    terms = (F.lit(60) + F.ceil(F.sqrt(nu)) * 4).cast("int")
    front = F.exp(a * F.log(x)) * ar * _gamma_ratio(a) / F.lit(math.sqrt(math.pi))
    p = F.when(x < (a + 1) / (a + F.lit(2.5)), front / a * _beta_fraction(a, half, x, terms)).otherwise(
        F.lit(1.0) - front * 2 * _beta_fraction(half, a, ar * ar, terms))
    return (F.when(r.isNull() | (n < 3), F.lit(None).cast("double"))
            .when(ar >= 1.0, F.lit(0.0))
            .when(ar == 0.0, F.lit(1.0))
            .otherwise(significant(p)))


def _betacf(a: float, b: float, x: float) -> float:
    """Continued fraction for the incomplete beta function (modified Lentz)."""
    tiny, eps = 1e-300, 1e-16
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10_000):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < eps:
            break
    return h


def regularized_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _betacf(a, b, x) / a
    return 1.0 - front * _betacf(b, a, 1.0 - x) / b


def pearson_p(r: float | None, n: int | None) -> float | None:
    """Two-sided p-value of H0: rho = 0 (Student t with n-2 degrees of freedom).

    Plain-Python reference (continued fraction of the incomplete beta
    function, full relative accuracy in the tail) for scalar checks on the
    driver; jobs use :func:`student_t_pvalue`.
    """
    if r is None or n is None or n < 3 or math.isnan(r):
        return None
    if abs(r) >= 1.0:
        return 0.0
    df = n - 2.0
    t2 = r * r * df / (1.0 - r * r)
    return regularized_beta(df / 2.0, 0.5, df / (df + t2))
