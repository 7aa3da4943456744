"""Distribution functions without a numerics package: Student's t and the binomial."""

from __future__ import annotations

import math


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - incomplete_beta(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + top * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + top / c
            c = c if abs(c) > tiny else tiny
            total *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * total


def t_cdf(t: float, df: float) -> float:
    tail = 0.5 * incomplete_beta(df / 2, 0.5, df / (df + t * t))
    return 1.0 - tail if t > 0 else tail


def t_quantile(p: float, df: float) -> float:
    """The *p* quantile of Student's t, by bisection."""
    if not 0.0 < p < 1.0:
        return math.inf if p >= 1.0 else -math.inf
    if p < 0.5:
        return -t_quantile(1.0 - p, df)
    low, high = 0.0, 1.0
    while t_cdf(high, df) < p:
        low, high = high, high * 2
        if high > 1e300:
            return high
    for _ in range(200):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        low, high = (middle, high) if t_cdf(middle, df) < p else (low, middle)
    return (low + high) / 2


def binomial_upper(x: int, n: int, p: float) -> float:
    """P(X > x) of a binomial."""
    if x >= n:
        return 0.0
    if x < 0:
        return 1.0
    return incomplete_beta(x + 1, n - x, p)


def binomial_pmf(x: int, n: int, p: float) -> float:
    if x < 0 or x > n:
        return 0.0
    if p <= 0.0 or p >= 1.0:
        return float(x == (n if p >= 1.0 else 0))
    return math.exp(math.lgamma(n + 1) - math.lgamma(x + 1) - math.lgamma(n - x + 1) + x * math.log(p) + (n - x) * math.log1p(-p))
