"""Upper tails of the t, F and chi-squared distributions, computed directly (not 1 - cdf).

Regularised incomplete beta by Lentz's continued fraction and incomplete gamma by series
or continued fraction, both in logarithms, so that tiny tails keep their digits.
"""

from __future__ import annotations

import math

import numpy as np

_TINY, _EPS = 1e-300, 1e-15


def _beta_fraction(a: float, b: float, x: float) -> float:
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > _TINY else _TINY)
    h = d
    for m in range(1, 2000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > _TINY else _TINY)
            c = 1.0 + num / c
            c = c if abs(c) > _TINY else _TINY
            h *= d * c
        if abs(d * c - 1) < _EPS:
            break
    return h


def log_beta_cdf(a: float, b: float, x: float) -> float:
    """ln of the regularised incomplete beta I_x(a, b)."""
    if x <= 0:
        return -math.inf
    if x >= 1:
        return 0.0
    front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1) / (a + b + 2):
        return front + math.log(_beta_fraction(a, b, x) / a)
    rest = math.exp(front) * _beta_fraction(b, a, 1 - x) / b
    return math.log1p(-min(rest, 1 - 1e-16))


def log_t_sf(t: float, df: float) -> float:
    """ln P(T > t)."""
    if not (df > 0) or math.isnan(t):
        return math.nan
    x = df / (df + t * t)
    half = log_beta_cdf(df / 2, 0.5, x) - math.log(2)
    return half if t >= 0 else math.log1p(-math.exp(half))


def log_f_sf(f: float, df1: float, df2: float) -> float:
    """ln P(F > f)."""
    if not (df1 > 0 and df2 > 0) or math.isnan(f):
        return math.nan
    return 0.0 if f <= 0 else log_beta_cdf(df2 / 2, df1 / 2, df2 / (df2 + df1 * f))


def log_chi2_sf(x: float, df: float) -> float:
    """ln P(X > x)."""
    if x <= 0:
        return 0.0
    a, z = df / 2, x / 2
    front = a * math.log(z) - z - math.lgamma(a)
    if z < a + 1:
        term = total = 1 / a
        for n in range(1, 5000):
            term *= z / (a + n)
            total += term
            if term < total * _EPS:
                break
        return math.log1p(-min(math.exp(front) * total, 1 - 1e-16))
    b, c = z + 1 - a, 1 / _TINY
    d = 1 / b
    h = d
    for i in range(1, 5000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > _TINY else _TINY)
        c = b + an / c
        c = c if abs(c) > _TINY else _TINY
        h *= d * c
        if abs(d * c - 1) < _EPS:
            break
    return front + math.log(h)


def minus_log10(log_p: np.ndarray | float, min_log: float = -323.3062153431158) -> np.ndarray:
    """-log10 p from ln p; what exceeds -min_log is cut to it, so that it stays finite."""
    return np.minimum(-np.asarray(log_p, dtype=float) / math.log(10), -min_log)


def t_to_p(t, df, min_log: float = -323.3062153431158) -> np.ndarray:
    """One-sided -log10 p of T statistics."""
    return minus_log10(np.vectorize(log_t_sf, otypes=[float])(t, df), min_log)


def f_to_p(f, rank, df, min_log: float = -323.3062153431158) -> np.ndarray:
    """-log10 p of F statistics."""
    return minus_log10(np.vectorize(log_f_sf, otypes=[float])(f, rank, df), min_log)
