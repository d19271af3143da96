"""Tails of distributions as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The first coefficients of Stirling's series, of 1/z, 1/z^3, 1/z^5 and so on.
STIRLING = [1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188]
#: Degrees of freedom above which the tail is taken from the normal distribution, and steps of the continued fractions.
MANY, STEPS = 50_000.0, 400
#: In place of a denominator of 0.
TINY = 1e-300


def log_gamma(z: Column) -> Column:
    """Of z > 0: Stirling's series at z + 10, less the logarithm of the factors between."""
    at = z + 10
    series = sum((c / F.pow(at, F.lit(2.0 * k + 1)) for k, c in enumerate(STIRLING)), F.lit(0.0))
    product = F.lit(1.0)
    for k in range(10):
        product = product * (z + k)
    return (at - 0.5) * F.log(at) - at + 0.5 * math.log(2 * math.pi) + series - F.log(product)


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, two terms a step."""
    safe = lambda v: F.when(F.abs(v) < TINY, F.lit(TINY)).otherwise(v)

    def step(s: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))

        def term(s, t):
            d, c = 1 / safe(1 + t * s["d"]), safe(1 + t / s["c"])
            return F.struct(c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h"))

        once = F.transform(F.array(term(s, even)), lambda half: term(half, odd))
        return once[0]

    d = 1 / safe(1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), d.alias("d"), d.alias("h"))
    return F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(STEPS)), lambda m: m.cast("double")), start, step, lambda s: s["h"])


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function, for a and b up to some ten thousands."""
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log1p(-x))
    inner = F.when(x < (a + 1) / (a + b + 2), front * _fraction(a, b, x) / a).otherwise(1 - front * _fraction(b, a, 1 - x) / b)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(inner)


def student_p(t: Column, df: Column) -> Column:
    """The chance of a t at least as far from 0, by Student's distribution: NULL without degrees of freedom.

    From MANY degrees on, t is turned into a normal deviate, whose tail differs by less than 1e-9 then.
    """
    df, t = df.cast("double"), F.abs(t)
    low = F.least(df, F.lit(MANY))
    exact = incomplete_beta(low / 2, F.lit(0.5), low / (low + t * t))
    z = t * (1 - 1 / (4 * df)) / F.sqrt(1 + t * t / (2 * df))
    return F.when(df > MANY, normal_p(z)).when(df > 0, exact)


def normal_p(z: Column) -> Column:
    """The chance of a normal deviate at least as far from 0: the power series near 0, else the continued fraction of the tail."""
    density = F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    odd = F.transform(F.sequence(F.lit(1), F.lit(80)), lambda k: 2.0 * k + 1)
    term = F.aggregate(odd, F.struct(z.alias("p"), z.alias("s")), lambda s, k: F.struct((s["p"] * z * z / k).alias("p"), (s["s"] + s["p"] * z * z / k).alias("s")), lambda s: s["s"])
    fraction = F.aggregate(F.sequence(F.lit(80), F.lit(1)), z, lambda c, k: z + k / c)
    return F.when(z < 3, 1 - 2 * density * term).otherwise(2 * density / fraction)
