"""Normal, t and chi-square tails for coefficient tables (a handful of numbers per model)."""

from __future__ import annotations

import math


def norm_sf2(z: float) -> float:
    """Two-sided normal tail."""
    return math.erfc(abs(z) / math.sqrt(2.0))


def _solve(f, target: float, low: float, high: float) -> float:
    """Root of an increasing function by bisection."""
    for _ in range(200):
        mid = 0.5 * (low + high)
        if f(mid) < target:
            low = mid
        else:
            high = mid
    return 0.5 * (low + high)


def norm_quantile(p: float) -> float:
    return _solve(lambda z: 0.5 * math.erfc(-z / math.sqrt(2.0)), p, -40.0, 40.0)


def _beta_fraction(x: float, a: float, b: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-16:
            break
    return h


def beta_inc(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(x, a, b) / a
    return 1.0 - front * _beta_fraction(1.0 - x, b, a) / b


def t_sf2(t: float, df: float) -> float:
    """Two-sided t tail."""
    if math.isinf(df) or df > 1e7:
        return norm_sf2(t)
    return beta_inc(df / (df + t * t), df / 2.0, 0.5)


def t_quantile(p: float, df: float) -> float:
    if df < 1:
        return float("nan")
    if math.isinf(df) or df > 1e7:
        return norm_quantile(p)
    sign = 1.0 if p >= 0.5 else -1.0
    tail = 2.0 * min(p, 1.0 - p)
    return sign * _solve(lambda t: -t_sf2(t, df), -tail, 0.0, 1e4)


def chi2_sf(x: float, df: float) -> float:
    """Upper tail of chi-square through the incomplete gamma function."""
    if x <= 0:
        return 1.0
    a, z = df / 2.0, x / 2.0
    front = math.exp(-z + a * math.log(z) - math.lgamma(a))
    if z < a + 1.0:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-17:
            n += 1.0
            term *= z / n
            total += term
        return 1.0 - total * front
    b = z + 1.0 - a
    c = 1e300
    d = h = 1.0 / b
    for i in range(1, 100_000):
        num = -i * (i - a)
        b += 2.0
        d = 1.0 / (num * d + b)
        c = b + num / c
        h *= d * c
        if abs(d * c - 1.0) < 1e-16:
            break
    return front * h
