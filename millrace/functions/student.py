"""Student's t distribution in plain Python, for a few aggregated rows."""

from __future__ import annotations

import math


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    tiny, c = 1e-300, 1.0
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for n in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + n * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + n / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def two_sided_p(t: float, df: float) -> float:
    """P(|T| >= |t|); NaN if t is."""
    if math.isnan(t):
        return math.nan
    return incomplete_beta(df / 2, 0.5, df / (df + t * t)) if math.isfinite(t) else 0.0


def quantile(p: float, df: float) -> float:
    """The t with P(T <= t) = p, by bisection."""
    lo, hi = -1e6, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        tail = two_sided_p(mid, df) / 2
        if (1 - tail if mid > 0 else tail) < p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2
