"""Tails of a few distributions, and digamma, on plain numbers."""

from __future__ import annotations

import math


def normal_sf(x: float) -> float:
    return 0.5 * math.erfc(x / math.sqrt(2))


def chi2_sf(x: float, k: float) -> float:
    """Upper regularised gamma, by series below k + 1 and by continued fraction above."""
    a, x = k / 2, x / 2
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-15 * abs(total):
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - front * total)
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return min(1.0, front * h)


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(500):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / ((1 + num * d) or 1e-300)
        c = (1 + num / c) or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def f_sf(f: float, d1: float, d2: float) -> float:
    return 1.0 if f <= 0 else beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def digamma(x: float) -> float:
    out = 0.0
    while x < 10:
        out -= 1 / x
        x += 1
    y = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y / 252))
