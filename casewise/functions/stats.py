"""Tail probabilities for the paired tests; scalars over one-row results."""

from __future__ import annotations

from functools import lru_cache
from math import erfc, exp, lgamma, log, sqrt


def normal_sf(z: float) -> float:
    return erfc(z / sqrt(2)) / 2


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    total = d
    for m in range(1, 4000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d or tiny)
            c = 1 + top / c or tiny
            total *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * total


def t_sf(t: float, df: float) -> float:
    """P(T > t) of Student's t; the normal tail above ten million degrees of freedom."""
    if df > 1e7:
        return normal_sf(t)
    tail = incomplete_beta(df / 2, 0.5, df / (df + t * t)) / 2
    return tail if t >= 0 else 1 - tail


def t_quantile(p: float, df: float) -> float:
    low, high = -1e3, 1e3
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - t_sf(mid, df) < p else (low, mid)
    return (low + high) / 2


@lru_cache(maxsize=64)
def _rank_sums(n: int) -> tuple[int, ...]:
    counts = [1]
    for k in range(1, n + 1):
        new = [0] * (len(counts) + k)
        for i, c in enumerate(counts):
            new[i] += c
            new[i + k] += c
        counts = new
    return tuple(counts)


def wilcoxon_exact_sf(w: float, n: int) -> float:
    """P(W+ >= w) of the signed-rank statistic without ties or zeros."""
    return sum(c for i, c in enumerate(_rank_sums(n)) if i >= w) / 2**n
