"""P-values of the two-sample Kolmogorov-Smirnov test."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

EXACT_UP_TO = 10_000


def exact_p(d: float, n: int, m: int) -> float:
    """Share of lattice paths from (0, 0) to (n, m) that leave the band |i/n - j/m| < d.

    Along each diagonal i + j = s the share of paths that have stayed inside so
    far follows from the diagonal before, so no count overflows.  Only the part
    of a diagonal that lies in the band is held.
    """
    reach = (d - 1e-12) * n * m  # |i m - j n| < reach
    inside, first = np.ones(1), 0  # the diagonal's values from i = first on
    for s in range(1, n + m + 1):
        # i m - (s - i) n = i (n + m) - s n
        lo = max(0, s - m, math.floor((s * n - reach) / (n + m)) - 1)
        hi = min(n, s, math.ceil((s * n + reach) / (n + m)) + 1)
        if hi < lo:
            return 1.0
        i = np.arange(lo, hi + 1)
        j = s - i
        before = np.zeros(hi - lo + 2)  # of i = lo - 1 .. hi on the last diagonal
        a, b = max(first, lo - 1), min(first + len(inside) - 1, hi)
        if b >= a:
            before[a - lo + 1 : b - lo + 2] = inside[a - first : b - first + 1]
        step = before[1:] * (j / s) + before[:-1] * (i / s)
        ok = np.abs(i / n - j / m) < d - 1e-12
        if s == n + m:
            ok[-1] = True
        inside, first = np.where(ok, step, 0.0), lo
    return float(min(1.0, max(0.0, 1.0 - inside[n - first])))


def asymptotic_p(d: float, n: int, m: int) -> float:
    """Kolmogorov's limit distribution."""
    x = d * math.sqrt(n * m / (n + m))
    if x < 0.2:
        return 1.0
    return float(min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * (k * x) ** 2) for k in range(1, 101)))))


def p_value(d: float, n: int, m: int) -> float:
    """Two-sided p-value: exact for samples up to EXACT_UP_TO, else the limit."""
    return exact_p(d, n, m) if max(n, m) <= EXACT_UP_TO else asymptotic_p(d, n, m)


def ks_p_value(d: str, n: str, m: str):
    """The p-value column of a statistic and two sample sizes."""

    @F.pandas_udf("double")
    def p(d: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([p_value(x, int(a), int(b)) for x, a, b in zip(d, n, m, strict=True)], dtype="float64")

    return p(d, n, m)
