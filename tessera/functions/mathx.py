"""Distribution functions that neither Spark nor numpy has: normal, Student t, exact Mann-Whitney."""

from __future__ import annotations

import itertools
import math
from functools import lru_cache

import numpy as np


def normal_sf(z: float) -> float:
    """Upper tail of the standard normal."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        k = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k))
        else:
            num = -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))
        d = 1 / (1 + num * d if abs(1 + num * d) > 1e-300 else 1e-300)
        c = 1 + num / c if abs(1 + num / c) > 1e-300 else 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1)


def t_two_sided(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    return beta_inc(df / 2, 0.5, df / (df + t * t)) if math.isfinite(t) else 0.0


def t_quantile(p: float, df: float) -> float:
    """The value that Student's t stays below with chance p (p of at least one half), by bisection."""
    lo, hi = 0.0, 1e3
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - t_two_sided(mid, df) / 2 < p else (lo, mid)
    return (lo + hi) / 2


def pearson_p(r: float, n: int) -> float:
    """Two-sided p-value of a correlation over n pairs."""
    if n < 3 or not math.isfinite(r):
        return float("nan")
    return 0.0 if abs(r) >= 1 else t_two_sided(r * math.sqrt((n - 2) / (1 - r * r + 1e-14)), n - 2)


@lru_cache(maxsize=256)
def mwu_counts(n1: int, n2: int) -> tuple[int, ...]:
    """In how many orders of n1 + n2 distinct values the statistic U takes 0, 1, ..., n1 * n2."""
    table = np.zeros((n1 + 1, n1 * n2 + 1), dtype=object)
    table[0, 0] = 1
    for value in range(1, n1 + n2 + 1):  # choose n1 ranks; a chosen rank r adds r less its place
        for k in range(min(n1, value), 0, -1):
            gain = value - k
            if gain <= n2:
                table[k, gain:] = table[k, gain:] + table[k - 1, : n1 * n2 + 1 - gain]
    return tuple(int(x) for x in table[n1])


def mwu_exact(u: float, n1: int, n2: int) -> float:
    """Exact two-sided p-value of U (the larger of U and n1 n2 - U counts), ties ignored."""
    if not n1 or not n2:
        return float("nan")
    counts = mwu_counts(n1, n2)
    top = max(int(u), n1 * n2 - int(u))
    return min(1.0, 2 * sum(counts[top:]) / sum(counts))


def mwu_greater(u: float, n1: int, n2: int, ties: float) -> float:
    """One-sided p-value of U by the normal law, with continuity and ties (sum of t^3 - t)."""
    n = n1 + n2
    if not n1 or not n2 or n < 2:
        return float("nan")
    var = n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1)))
    return 1.0 if var <= 0 else normal_sf((u - n1 * n2 / 2 - 0.5) / math.sqrt(var))


# --- the same over arrays, without a step per row --------------------------------------------------


def normal_sf_array(z: np.ndarray) -> np.ndarray:
    """Upper tail of the standard normal: a power series near the middle, a continued fraction in the tails."""
    z = np.asarray(z, float)
    a = np.minimum(np.abs(z), 40.0)
    near = np.where(a < 3, a, 0.0)
    term, total = near.copy(), near.copy()
    for k in range(3, 101, 2):
        term = term * near * near / k
        total += term
    far = np.where(a < 3, 3.0, a)
    below = far.copy()
    for k in range(100, 0, -1):
        below = far + k / below
    density = np.exp(-a * a / 2) / math.sqrt(2 * math.pi)
    upper = np.where(a < 3, 0.5 - density * total, density / below)
    return np.where(np.isnan(z), np.nan, np.where(z >= 0, upper, 1 - upper))


def _by_value(f, x: np.ndarray) -> np.ndarray:
    """``f`` of each distinct value, taken to where it occurs."""
    values, at = np.unique(x, return_inverse=True)
    return np.array([f(v) for v in values], float)[at]


def pearson_p_array(r: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Two-sided p-values of correlations over n pairs: Student's t by the incomplete beta function, all rows at once."""
    r, n = np.asarray(r, float), np.asarray(n, float)
    usable = np.isfinite(r) & (n >= 3)
    full = usable & (np.abs(r) >= 1)
    df = np.where(usable, n - 2, 1.0)
    rr = np.where(usable & ~full, r, 0.5)
    t2 = rr * rr * df / (1 - rr * rr + 1e-14)
    x = df / (df + t2)
    a, b = df / 2, np.full(len(r), 0.5)
    turned = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(turned, b, a), np.where(turned, a, b), np.where(turned, 1 - x, x)
    lg = lambda v: _by_value(math.lgamma, v)
    inner = (x > 0) & (x < 1)
    y = np.where(inner, x, 0.5)
    front = np.exp(lg(a + b) - lg(a) - lg(b) + a * np.log(y) + b * np.log1p(-y)) / a
    tiny = lambda v: np.where(np.abs(v) > 1e-300, v, 1e-300)
    f, c, d = np.ones(len(r)), np.ones(len(r)), np.zeros(len(r))
    for i in range(400):
        k = i // 2
        num = np.ones(len(r)) if i == 0 else k * (b - k) * y / ((a + 2 * k - 1) * (a + 2 * k)) if i % 2 == 0 else -(a + k) * (a + b + k) * y / ((a + 2 * k) * (a + 2 * k + 1))
        d, c = 1 / tiny(1 + num * d), tiny(1 + num / c)
        f = f * c * d
        if (np.abs(1 - c * d) < 1e-15).all():
            break
    part = np.where(inner, front * (f - 1), (x >= 1).astype(float))
    return np.where(full, 0.0, np.where(usable, np.where(turned, 1 - part, part), np.nan))


def mwu_greater_array(u: np.ndarray, n1: np.ndarray, n2: np.ndarray, ties: np.ndarray) -> np.ndarray:
    """``mwu_greater`` of all rows."""
    u, n1, n2, ties = (np.asarray(v, float) for v in (u, n1, n2, ties))
    n = n1 + n2
    with np.errstate(divide="ignore", invalid="ignore"):
        var = n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1)))
        z = (u - n1 * n2 / 2 - 0.5) / np.sqrt(np.where(var > 0, var, 1.0))
    return np.where((n1 > 0) & (n2 > 0), np.where(var <= 0, 1.0, normal_sf_array(z)), np.nan)


def mwu_exact_array(u: np.ndarray, n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """``mwu_exact`` of all rows: the counts of a pair of sizes are added up once."""
    u, n1, n2 = np.asarray(u, float), np.asarray(n1, np.int64), np.asarray(n2, np.int64)
    out = np.full(len(u), np.nan)
    for a, b in {(int(a), int(b)) for a, b in zip(np.unique(n1 * (1 << 31) + n2) >> 31, np.unique(n1 * (1 << 31) + n2) & ((1 << 31) - 1), strict=True)}:
        at = (n1 == a) & (n2 == b) & ~np.isnan(u)
        if a and b and at.any():
            counts = mwu_counts(a, b)
            whole, upper = sum(counts), list(itertools.accumulate(reversed(counts)))[::-1]
            tail = np.array([min(1.0, 2 * c / whole) for c in upper])
            low = np.floor(u[at]).astype(np.int64)
            out[at] = tail[np.maximum(low, a * b - low)]
    return out
