"""Chi-square upper tail and quantile, for small reports on the driver."""

from __future__ import annotations

import math


def upper_tail(x: float, dof: int) -> float:
    """P(X >= x) for a chi-square variable: the regularised upper incomplete gamma function."""
    a, x = dof / 2, x / 2
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:  # series of the lower part
        term = total = 1 / a
        n = a
        while term > total * 1e-17:
            n += 1
            term *= x / n
            total += term
        return 1 - scale * total
    tiny = 1e-300  # continued fraction of the upper part
    b, c = x + 1 - a, 1 / tiny
    d = h = 1 / b
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return scale * h


def quantile(p: float, dof: int) -> float:
    """x with P(X <= x) = p, by bisection."""
    low, high = 0.0, float(dof)
    while upper_tail(high, dof) > 1 - p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        if upper_tail(mid, dof) > 1 - p:
            low = mid
        else:
            high = mid
    return (low + high) / 2
