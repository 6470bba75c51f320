"""Tails and quantiles of the F, t and chi-squared distributions, in plain Python."""

from __future__ import annotations

import math


def _fraction(a: float, b: float, x: float) -> float:
    """Lentz's evaluation of the continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 1000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return out


def beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function I_x(a, b)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _fraction(a, b, x) / a
    return 1 - front * _fraction(b, a, 1 - x) / b


def f_tail(d1: float, d2: float, f: float) -> float:
    """P(F > f) with d1 and d2 degrees of freedom; NaN where that has no meaning."""
    if math.isnan(f) or d1 <= 0 or d2 <= 0:
        return math.nan
    if math.isinf(f):
        return 0.0
    return 1.0 if f <= 0 else beta_share(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def t_quantile(d: float, p: float) -> float:
    """The p-quantile of Student's t, by bisection on the tail."""
    if p == 0.5:
        return 0.0
    if p < 0.5:
        return -t_quantile(d, 1 - p)
    low, high = 0.0, 1.0
    while f_tail(1, d, high * high) / 2 > 1 - p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if f_tail(1, d, mid * mid) / 2 > 1 - p else (low, mid)
    return (low + high) / 2


def chi2_tail(k: float, x: float) -> float:
    """P(X > x) for chi-squared with k degrees of freedom."""
    if math.isnan(x) or k <= 0:
        return math.nan
    if x <= 0:
        return 1.0
    a, x = k / 2, x / 2
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-17:
            n += 1
            term *= x / n
            total += term
        return 1 - front * total
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    out = d
    for i in range(1, 1000):
        num = -i * (i - a)
        b += 2
        d = 1 / (num * d + b or tiny)
        c = b + num / c or tiny
        out *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * out
