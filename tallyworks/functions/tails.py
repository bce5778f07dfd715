"""Tail probabilities of test statistics as column expressions.

Meant for results of a few rows: a statistic's tail is a fixed number of steps over one
row, all in the JVM.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Steps of the continued fraction. It needs about the root of the larger parameter.
STEPS = 2000
# Arguments are moved up by so much before the asymptotic series.
SHIFT = 12
# Coefficients of Stirling's series of the log gamma function.
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)


def _series(z: Column) -> Column:
    total = F.lit(0.0)
    for i, c in enumerate(STIRLING):
        total = total + c / F.pow(z, F.lit(2.0 * i + 1))
    return total


def log_gamma_step(a: Column, b: float) -> Column:
    """Log of gamma(a + b) / gamma(a), without the cancellation of two large logarithms.

    For a > 0 and a + b > 0.
    """
    high = a + SHIFT
    shifted = (high + b - 0.5) * F.log1p(b / high) + b * F.log(high) - b + _series(high + b) - _series(high)
    for i in range(SHIFT):
        shifted = shifted - F.log1p(b / (a + i))
    return shifted


def _fraction(x: Column, a: Column, b: Column) -> Column:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = F.lit(1e-300)
    safe = lambda v: F.when(F.abs(v) < tiny, tiny).otherwise(v)
    state = lambda c, d, h: F.struct(c.alias("c"), d.alias("d"), h.alias("h"))
    first = 1.0 / safe(1 - (a + b) * x / (a + 1))

    def half(s: Column, factor: Column) -> Column:
        d = 1.0 / safe(1 + factor * s["d"])
        c = safe(1 + factor / s["c"])
        return F.transform(F.array(state(c, d, s["h"])), lambda v: state(v["c"], v["d"], v["h"] * v["c"] * v["d"]))[0]

    def step(s: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        done = F.transform(F.array(half(s, even)), lambda v: half(v, odd))[0]
        # Settled rows keep their value, so further steps add no rounding.
        return F.when(F.abs(s["c"] * s["d"] - 1) < 1e-17, s).otherwise(done)

    steps = F.transform(F.sequence(F.lit(1), F.lit(STEPS)), lambda m: m.cast("double"))
    return F.aggregate(steps, state(F.lit(1.0), first, first), step, lambda s: s["h"])


def student_tail(t: Column, freedom: Column) -> Column:
    """Two-sided tail of Student's t: the regularised incomplete beta function
    I(freedom / (freedom + t^2); freedom / 2, 1/2).

    Null where the statistic or its degrees of freedom are missing, not a number or not
    positive. Uses whichever end of the fraction converges.
    """
    v = freedom.cast("double")
    t = t.cast("double")
    part = t * t / v
    a, half = v / 2, F.lit(0.5)
    # Logarithms of x = v / (v + t^2) and of 1 - x, exact also where x is close to 1.
    log_x = -F.log1p(part)
    log_rest = F.log(part) + log_x
    log_beta = math.lgamma(0.5) - log_gamma_step(a, 0.5)
    front = F.exp(a * log_x + 0.5 * log_rest - log_beta)
    x, rest = F.exp(log_x), part / (1 + part)
    outer = front * _fraction(x, a, half) / a
    inner = 1 - front * _fraction(rest, half, a) / 0.5
    near = x < (a + 1) / (a + 2.5)
    usable = t.isNotNull() & ~F.isnan(t) & v.isNotNull() & ~F.isnan(v) & (v > 0)
    tail = F.when(part == 0, F.lit(1.0)).when(F.isnan(part) | (part == float("inf")), F.lit(0.0))
    return F.when(usable, tail.when(near, outer).otherwise(inner))
