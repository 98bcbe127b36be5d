"""Tails of distributions and small-sample tests in NumPy: Student t, normal, Shapiro-Wilk, Wilcoxon."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

_NORMAL = NormalDist()


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function by its continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 / max(1e-300, 1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def t_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t)) if df > 0 else math.nan


def ttest_p(values: np.ndarray) -> float | None:
    """One-sample t test against 0; constant values give 1 if they are 0, else 0."""
    n = len(values)
    if n < 2:
        return None
    sd = values.std(ddof=1)
    if sd == 0 or np.allclose(values, values[0]):
        return 1.0 if np.isclose(values[0], 0) else 0.0
    return t_two_sided(values.mean() / (sd / math.sqrt(n)), n - 1)


def correlation_p(r: float, n: int) -> float | None:
    """Two-sided p of a correlation of n pairs by t with n - 2 degrees of freedom."""
    if n < 3 or r is None or math.isnan(r):
        return None
    return 0.0 if abs(r) >= 1 else t_two_sided(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)


def shapiro_p(values: np.ndarray) -> float | None:
    """Shapiro-Wilk p by Royston's approximation (3 to 5000 values, not all equal); else None."""
    x = np.sort(np.asarray(values, float))
    n = len(x)
    if n < 3 or n > 5000 or x[0] == x[-1]:
        return None
    m = np.array([_NORMAL.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    ssq = (m**2).sum()
    a = m / math.sqrt(ssq)
    if n == 3:
        a = np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    else:
        u = 1 / math.sqrt(n)
        last = np.polyval([-2.706056, 4.434685, -2.07119, -0.147981, 0.221157, a[-1]], u)
        if n > 5:
            second = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, a[-2]], u)
            rest = math.sqrt((ssq - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2))
            a = np.concatenate(([-last, -second], m[2:-2] / rest, [second, last]))
        else:
            rest = math.sqrt((ssq - 2 * m[-1] ** 2) / (1 - 2 * last**2))
            a = np.concatenate(([-last], m[1:-1] / rest, [last]))
    w = min(1.0, float((a * x).sum() ** 2 / ((x - x.mean()) ** 2).sum()))
    if n == 3:
        return max(0.0, min(1.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))))
    y = math.log(1 - w) if w < 1 else -math.inf
    if n <= 11:
        gamma = 0.459 * n - 2.273
        if y >= gamma:
            return 1e-19
        y = -math.log(gamma - y)
        mu, sd = np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n), math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        k = math.log(n)
        mu, sd = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], k), math.exp(np.polyval([0.0030302, -0.082676, -0.4803], k))
    return 1 - _NORMAL.cdf((y - mu) / sd)


def wilcoxon_p(values: np.ndarray) -> float | None:
    """Two-sided signed-rank p without zeros: exact for up to 50 values without ties, else the normal approximation with tie correction."""
    v = np.asarray(values, float)
    v = v[~np.isclose(v, 0)]
    if len(values) and not len(v):
        return 1.0
    n = len(v)
    if n < 2:
        return None
    order = np.abs(v)
    _, place, counts = np.unique(order, return_inverse=True, return_counts=True)
    ranks = (np.cumsum(counts) - (counts - 1) / 2)[place]
    plus = float(ranks[v > 0].sum())
    low = min(plus, n * (n + 1) / 2 - plus)
    if n <= 50 and (counts == 1).all() and n == len(values):
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for r in range(1, n + 1):
            ways[r:] = ways[r:] + ways[: len(ways) - r]
        return min(1.0, 2 * ways[: int(low) + 1].sum() / 2.0**n)
    sd = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - (counts**3 - counts).sum() / 48)
    return min(1.0, 2 * _NORMAL.cdf((low - n * (n + 1) / 4) / sd))


#: Numbers drawn at a time, unless one sample has more.
BLOCK = 1 << 16


def _blocks(draws: int, n: int) -> list[int]:
    """Samples of n numbers in blocks. One seeded stream gives the same numbers block by block as at once."""
    rows = max(1, BLOCK // max(1, n))
    return [min(rows, draws - a) for a in range(0, draws, rows)]


def bootstrap_ci(values: np.ndarray, draws: int = 2000, seed: int = 42) -> tuple[float, float]:
    """Percentile interval (2.5, 97.5) of resampled means; memory for a block of samples and the means."""
    stream = np.random.default_rng(seed)
    means = np.concatenate([stream.choice(values, size=(rows, len(values)), replace=True).mean(axis=1) for rows in _blocks(draws, len(values))])
    return tuple(float(q) for q in np.quantile(means, [0.025, 0.975]))


def sign_flip_p(values: np.ndarray, draws: int = 4000, seed: int = 42) -> float:
    """Share of random sign changes whose mean is at least as far from 0; memory for a block of samples."""
    stream, least = np.random.default_rng(seed), abs(values.mean())
    far = [(np.abs((stream.choice([-1.0, 1.0], size=(rows, len(values))) * values).mean(axis=1)) >= least).sum() for rows in _blocks(draws, len(values))]
    return float(sum(far) / draws)
