"""Paired tests of two scores: t, signed rank, normality, bootstrap.

Pairs are few (one for each group under study); means and sums are aggregates, the rest one grouped step a group.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESAMPLES, SEED = 10_000, 42


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz's scheme."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + term * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + term / (c if abs(c) > tiny else tiny)
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, freedom: int) -> float:
    return incomplete_beta(freedom / 2, 0.5, freedom / (freedom + t * t))


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def normal_quantile(p: float) -> float:
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if normal_cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2


def paired_t(d: np.ndarray) -> tuple[float | None, float | None]:
    """(t, two-sided p); none for fewer than two differences."""
    n = len(d)
    if n < 2:
        return None, None
    spread = d.std(ddof=1)
    if spread == 0:
        return (None, None) if d.mean() == 0 else (math.copysign(math.inf, d.mean()), 0.0)
    t = d.mean() / (spread / math.sqrt(n))
    return float(t), t_two_sided(float(t), n - 1)


def wilcoxon(d: np.ndarray) -> tuple[float | None, float | None]:
    """(lesser rank sum, two-sided p); none for fewer than six non-zero differences.

    Exact for up to 50 without ties or zeros, else the normal approximation with the ties' correction.
    """
    live = d[d != 0]
    n = len(live)
    if n < 6:
        return None, None
    rank = pd.Series(np.abs(live)).rank().to_numpy()
    plus, minus = rank[live > 0].sum(), rank[live < 0].sum()
    w = float(min(plus, minus))
    sizes = np.unique(np.abs(live), return_counts=True)[1]
    if n <= 50 and n == len(d) and sizes.max() == 1:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for k in range(1, n + 1):
            ways[k:] += ways[:-k].copy()
        return w, float(min(1.0, 2 * ways[: int(w) + 1].sum() / 2.0**n))
    var = n * (n + 1) * (2 * n + 1) / 24 - (sizes**3 - sizes).sum() / 48
    return w, float(2 * normal_cdf((w - n * (n + 1) / 4) / math.sqrt(var)))


def shapiro(d: np.ndarray) -> tuple[float | None, float | None]:
    """(W, p) by Royston's approximation (AS R94); none for fewer than three values or values all alike."""
    n = len(d)
    if n < 3:
        return None, None
    x = np.sort(d)
    if x[0] == x[-1]:
        return 1.0, 1.0
    m = np.array([normal_quantile((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    total, u = (m * m).sum(), 1 / math.sqrt(n)
    a = m / math.sqrt(total)
    if n == 3:
        a = np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    else:
        last = np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, a[-1]], u)
        if n > 5:
            prior = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, a[-2]], u)
            phi = (total - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * prior**2)
            a = m / math.sqrt(phi)
            a[-2], a[1] = prior, -prior
        else:
            a = m / math.sqrt((total - 2 * m[-1] ** 2) / (1 - 2 * last**2))
        a[-1], a[0] = last, -last
    w = min(1.0, float((a * x).sum() ** 2 / ((x - x.mean()) ** 2).sum()))
    if n == 3:
        p = 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))
        return w, max(0.0, p)
    if w == 1.0:
        return w, 1.0
    if n <= 11:
        gamma = -2.273 + 0.459 * n
        if math.log1p(-w) >= gamma:
            return w, 0.0
        z = (-math.log(gamma - math.log1p(-w)) - np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n)) / math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        k = math.log(n)
        z = (math.log1p(-w) - np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], k)) / math.exp(np.polyval([0.0030302, -0.082676, -0.4803], k))
    return w, 1 - normal_cdf(float(z))


def bootstrap(d: np.ndarray, n: int = RESAMPLES, seed: int = SEED) -> tuple[float | None, float | None, float | None]:
    """(mean, 2.5th and 97.5th percentile) of resampled mean differences; none for fewer than two."""
    if len(d) < 2:
        return None, None, None
    rng = np.random.RandomState(seed)
    means = np.array([d[rng.choice(len(d), len(d), replace=True)].mean() for _ in range(n)])
    return float(means.mean()), *(float(x) for x in np.percentile(means, [2.5, 97.5]))


def paired_tests(pairs: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """One row a group of complete pairs: n, means, sample deviations, difference, verdict, and the four tests.

    A group's differences are read by one task: groups are systems under comparison, their pairs the items they were
    tried on.
    """
    kind = pairs.schema[group].dataType.simpleString()
    full = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    r4 = lambda c: F.bround(c, 4)
    facts = full.groupBy(group).agg(F.count("*").alias("n_pairs"), F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.stddev_samp(a).alias("sa"), F.stddev_samp(b).alias("sb"))
    diff = F.col("ma") - F.col("mb")
    verdict = F.when(diff > 0, "first").when(diff < 0, "second").otherwise("none")
    facts = facts.select(group, "n_pairs", r4("ma").alias("mean_a"), r4("mb").alias("mean_b"), r4("sa").alias("std_a"), r4("sb").alias("std_b"), r4(diff).alias("difference"), verdict.alias("better"))

    def tests(rows: pd.DataFrame) -> pd.DataFrame:
        d = (rows[a].astype(float) - rows[b].astype(float)).to_numpy()
        places = lambda x, k: None if x is None or not math.isfinite(x) else round(x, k)
        (t, tp), (w, wp), (s, sp), (m, lo, hi) = paired_t(d), wilcoxon(d), shapiro(d), bootstrap(d)
        return pd.DataFrame([[rows[group].iloc[0], places(t, 4), places(tp, 6), places(w, 4), places(wp, 6), places(s, 4), places(sp, 6), places(m, 6), places(lo, 6), places(hi, 6)]], columns=["g", "t", "t_p", "w", "w_p", "shapiro_w", "shapiro_p", "boot_mean", "boot_low", "boot_high"])

    measured = full.select(group, a, b).groupBy(group).applyInPandas(tests, f"g {kind}, t double, t_p double, w double, w_p double, shapiro_w double, shapiro_p double, boot_mean double, boot_low double, boot_high double")
    return facts.join(measured, facts[group] == measured["g"]).drop("g")
