"""Detectors that need a whole series at once, as grouped numpy functions.

A series here is the minima of its time bins.  All detectors take memory that is
linear in its length; time is linear in what the starts that are still kept (or
the messages that are not truncated) reach, which is the length of segments
rather than of the series.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_SIZE = 2
JUMP = 5


class SpreadCost:
    """Squares around the mean ("l2"), or the log-likelihood of a normal segment ("normal"), from prefix sums."""

    def __init__(self, x: np.ndarray, model: str):
        x = x - x.mean() if len(x) else x
        self.s1, self.s2, self.model = np.concatenate(([0.0], np.cumsum(x))), np.concatenate(([0.0], np.cumsum(x * x))), model

    def at(self, live: np.ndarray, ok: np.ndarray, e: int) -> np.ndarray:
        a, s1, s2 = live[ok], self.s1, self.s2
        spread = np.maximum(s2[e] - s2[a] - (s1[e] - s1[a]) ** 2 / (e - a), 0.0)
        return spread if self.model == "l2" else (e - a) * np.log(np.maximum(spread / (e - a), 1e-8))


class MedianCost:
    """Distances to the median ("l1"): upper half less lower half, from a wavelet matrix of the ranks.

    Each level holds, for the values in its order, how many of the first i have
    a zero bit and the sum of the first i; the sum of the k least values of any
    stretch takes one step per level, for all starts at once.
    """

    def __init__(self, x: np.ndarray):
        n = len(x)
        ranks = np.empty(n, np.int64)
        ranks[np.argsort(x, kind="stable")] = np.arange(n)
        self.total = np.concatenate(([0.0], np.cumsum(x)))
        self.levels: list[tuple[np.ndarray, int, np.ndarray]] = []
        for bit in range(max(1, int(n - 1).bit_length()) - 1, -1, -1):
            ones = (ranks >> bit & 1).astype(bool)
            zeros = np.concatenate(([0], np.cumsum(~ones)))
            order = np.concatenate((np.flatnonzero(~ones), np.flatnonzero(ones)))
            ranks, x = ranks[order], x[order]
            self.levels.append((zeros, int(zeros[-1]), np.concatenate(([0.0], np.cumsum(x)))))

    def least(self, a: np.ndarray, e: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The sum of the k least values of each [a, e)."""
        out, sums = np.zeros(len(a)), self.total
        for zeros, middle, sums in self.levels:
            za, ze = zeros[a], zeros[e]
            right = k > ze - za
            out += np.where(right, sums[ze] - sums[za], 0.0)
            k = np.where(right, k - (ze - za), k)
            a, e = np.where(right, middle + a - za, za), np.where(right, middle + e - ze, ze)
        return out + sums[a + k] - sums[a]

    def at(self, live: np.ndarray, ok: np.ndarray, e: int) -> np.ndarray:
        a = live[ok]
        end, m = np.full(len(a), e), e - a
        return self.total[e] - self.total[a] - self.least(a, end, m - m // 2) - self.least(a, end, m // 2)


class KernelCost:
    """Gaussian kernel cost ("rbf"), with one running sum per start that is still kept.

    As the end moves on, the kernel between the new values and all before is
    summed from the right, which adds to every start's sum at once.  Memory is
    linear in the series; time is linear in the values that kept starts reach.
    """

    LOW = 1e-2  # the exponent's least value, also on the diagonal

    def __init__(self, x: np.ndarray):
        self.x, self.middle = x, _median_distance(x)
        self.starts, self.sums, self.end = np.zeros(1, np.int64), np.zeros(1), 0

    def _kernel(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d = (a[:, None] - b[None, :]) ** 2
        return np.exp(-np.clip(d / self.middle if self.middle > 0 else d, self.LOW, 1e2))

    def at(self, live: np.ndarray, ok: np.ndarray, e: int) -> np.ndarray:
        """``live`` rises, and holds no start below ``end`` that was not live before."""
        old = live[live < self.end] if self.end else live[:1]
        sums = self.sums[np.searchsorted(self.starts, old)]
        self.starts, self.sums = live, np.concatenate((sums, np.zeros(len(live) - len(old))))
        new = self.x[self.end : e]
        lo = int(live[0])
        if self.end > lo:
            side = np.concatenate([self._kernel(self.x[k : min(k + 4096, self.end)], new).sum(axis=1) for k in range(lo, self.end, 4096)])
            upto = np.append(np.cumsum(side[::-1])[::-1], 0.0)
            self.sums = self.sums + 2 * upto[np.minimum(live, self.end) - lo]
        self.sums = self.sums + self._kernel(new, new).sum()
        self.end = e
        length = e - live[ok]
        return np.exp(-self.LOW) * length - self.sums[ok] / length


def segment_cost(x: np.ndarray, model: str) -> SpreadCost | MedianCost | KernelCost:
    """Costs of the segments that end at rising places, by :meth:`at` (live starts, which of them are asked for, end)."""
    return SpreadCost(x, model) if model in ("l2", "normal") else MedianCost(x) if model == "l1" else KernelCost(x)


def _median_distance(x: np.ndarray) -> float:
    """The median of the squared distances of all pairs, by counting the pairs up to a distance."""
    n = len(x)
    pairs = n * (n - 1) // 2
    if not pairs:
        return 0.0
    x = np.sort(x)

    def nth(k: int) -> float:
        """The least double that k pairs are not beyond."""
        lo, hi = 0, int(np.float64(x[-1] - x[0]).view(np.int64))
        while lo < hi:
            mid = (lo + hi) // 2
            d = float(np.int64(mid).view(np.float64))
            if int((np.searchsorted(x, x + d, side="right") - np.arange(n) - 1).sum()) >= k:
                hi = mid
            else:
                lo = mid + 1
        return float(np.int64(lo).view(np.float64))

    return (nth((pairs + 1) // 2) ** 2 + nth(pairs // 2 + 1) ** 2) / 2


def optimal_partition(x: np.ndarray, penalty: float, model: str = "rbf", jump: int = JUMP, min_size: int = MIN_SIZE) -> list[int]:
    """Starts of the later segments of the cheapest partition on the grid of ``jump``; PELT pruning."""
    n = len(x)
    if n < 2 * min_size:
        return []
    cost = segment_cost(x, model)
    ends = [e for e in range(0, n, jump) if e >= min_size] + [n]
    best, last = np.zeros(n + 1), {}
    live = np.array([0])
    for e in ends:
        ok = e - live >= min_size
        values = cost.at(live, ok, e)
        if not ok.any():
            continue
        asked = live[ok]
        base = best[asked] + values
        i = int(np.argmin(base))
        best[e], last[e] = float(base[i]) + penalty, int(asked[i])
        live = np.concatenate((asked[base <= best[e]], live[~ok], [e]))
    out, at = [], n
    while last.get(at, 0):
        at = last[at]
        out.append(at)
    return out[::-1]


def boundary_confidence(x: np.ndarray, i: int) -> float:
    """From the change of mean and variance over at most ten rows on either side."""
    w = min(10, i, len(x) - i)
    if w < 2:
        return 0.5
    a, b = x[i - w : i], x[i : i + w]
    return float(np.clip((abs(b.mean() - a.mean()) + abs(b.var() - a.var())) / 10, 0, 1))


def _spaced(epochs: np.ndarray, places: list[int], gap: float) -> list[int]:
    out: list[int] = []
    for i in places:
        if not out or epochs[i] - epochs[out[-1]] >= gap:
            out.append(i)
    return out


def pelt(epochs: np.ndarray, x: np.ndarray, model: str = "rbf", penalty: float = 10.0, threshold: float = 0.25, gap: float = 1800) -> tuple[list[int], list[float], str]:
    """Places, confidences and label; a lower penalty is tried if fewer than ten are found."""
    pen = max(0.1, penalty * (1 - threshold))
    label = f"ruptures_{model}"
    found = _spaced(epochs, optimal_partition(x, pen, model), gap)
    if len(found) < 10:
        found, label = _spaced(epochs, optimal_partition(x, 0.3 * pen, model), gap), f"{label}_lowpen"
    return found, [boundary_confidence(x, i) for i in found], label


#: Logarithm of the share of a sum below which terms are left out, and how many terms are bounded at once.
NEGLIGIBLE, STRETCH = -60.0, 64


def _log_total(*parts: np.ndarray) -> float:
    top = max(float(p.max()) for p in parts)
    return top + math.log(sum(float(np.exp(p - top).sum()) for p in parts))


def _messages(x: np.ndarray, truncate: bool) -> np.ndarray:
    """Logarithm of the evidence of x[t:] for each t, where a change comes before each segment.

    With ``truncate``, a stretch of segment ends is left out where a bound of its
    terms is NEGLIGIBLE beside the others: beta never falls as a segment grows,
    the rest of the evidence is convex in the length, and the messages of a
    stretch lie below a line.
    """
    n = len(x)
    p = 1.0 / (n + 1)
    move = math.log(p)
    s1, s2 = np.concatenate(([0.0], np.cumsum(x))), np.concatenate(([0.0], np.cumsum(x * x)))
    gammas = np.array([math.lgamma(1 + k / 2) for k in range(n + 1)])
    sizes = np.arange(n + 1)
    # What depends on a segment's length alone.
    fixed = gammas - 0.5 * np.log(1 + sizes) - sizes / 2 * np.log(2 * np.pi) + np.maximum(sizes - 1, 0) * np.log1p(-p)

    def spread(t: int, e: np.ndarray, m: np.ndarray) -> np.ndarray:
        """The logarithm of beta."""
        total = s1[e] - s1[t]
        square = total * total / m
        return np.log(np.maximum(1 + 0.5 * (s2[e] - s2[t] - square) + square / (2 * (1 + m)), 1e-300))

    out = np.zeros(n + 1)

    def terms(t: int, e: np.ndarray) -> np.ndarray:
        m = e - t
        return fixed[m] - (1 + m / 2) * spread(t, e, m) + out[e]

    first = np.arange(0, n + 1, STRETCH)
    last = np.minimum(first + STRETCH - 1, n)
    top, slope = np.zeros(len(first)), np.zeros(len(first))
    places = np.arange(STRETCH)

    def members(stretches: np.ndarray) -> np.ndarray:
        e = (first[stretches][:, None] + places).reshape(-1)
        return e[e <= n]

    for t in range(n - 1, -1, -1):
        far = t // STRETCH + 2 if truncate else len(first)
        parts = [terms(t, np.arange(t + 1, min(n, far * STRETCH - 1) + 1))]
        if far < len(first):
            begin, end = first[far:], last[far:]
            m, k = begin - t, end - t
            low = spread(t, begin, m)
            bound = top[far:] + np.maximum(fixed[m] - (1 + m / 2) * low, fixed[k] - (1 + k / 2) * low + slope[far:] * (end - begin))
            best = int(np.argmax(bound))
            total = _log_total(parts[0])
            if bound[best] > total + NEGLIGIBLE:
                parts.append(terms(t, members(np.array([far + best]))))
                total, bound[best] = _log_total(*parts), -np.inf
                rest = np.flatnonzero(bound > total + NEGLIGIBLE)
                if len(rest):
                    parts.append(terms(t, members(far + rest)))
        out[t] = _log_total(*parts) + move
        if t % STRETCH == 0:
            j = t // STRETCH
            mine = out[t : last[j] + 1]
            slope[j] = (mine[-1] - mine[0]) / max(len(mine) - 1, 1)
            top[j] = (mine - slope[j] * places[: len(mine)]).max()
    return out


def change_probabilities(x: np.ndarray, truncate: bool = True) -> np.ndarray:
    """Posterior probability of a change at each row (Fearnhead's recursions forwards and backwards).

    Segments are normal with a Normal-Gamma(0, 1, 1, 1) prior, changes have a
    constant prior probability.  The message forwards is that of the reversed
    series.  Where ends far off cannot matter, which a bound tells, they are left
    out (``truncate``), so time follows what reaches a place rather than the
    square of the series; memory is linear.
    """
    after, before = _messages(x, truncate), _messages(x[::-1], truncate)[::-1]
    out = np.exp(before[:-1] + after[:-1] - after[0])
    out[0] = 0.0
    return np.clip(out, 0.0, 1.0)


def bcp(epochs: np.ndarray, x: np.ndarray, threshold: float = 0.25) -> tuple[list[int], list[float], str]:
    """Places whose change probability is above the threshold."""
    if len(x) < 2:
        return [], [], "bayesian_cp"
    p = change_probabilities(x)
    found = np.flatnonzero(p > threshold).tolist()
    return found, [float(p[i]) for i in found], "bayesian_cp"


#: Scores whose relative distance is below this are equal but for rounding.
SAME_SCORE = 1e-9


def score_ranks(scores: np.ndarray) -> np.ndarray:
    """0 for the highest score, and one more for each next lower one; scores that differ by rounding only share a rank."""
    order = np.argsort(-scores, kind="stable")
    falling = scores[order]
    ranks = np.empty(len(scores), np.int64)
    ranks[order] = np.cumsum(np.concatenate(([0], falling[:-1] - falling[1:] > SAME_SCORE * np.abs(falling[:-1]))))[: len(scores)]
    return ranks


def welch_grid(epochs: np.ndarray, scores: np.ndarray, threshold: float = 0.25, gap: float = 1800, most: int | None = None) -> tuple[list[int], list[float], str]:
    """Candidates chosen over an even time grid, then by rank where there are few; of equal scores the earlier goes first."""
    label = "torch_statistical"
    mu, sd = scores.mean(), scores.std()
    high, mid, low = (max(mu + k * threshold * sd, least) for k, least in ((3, 1.0), (1.5, 0.7), (0.5, 0.3)))
    ranks = score_ranks(scores)
    cand = [(1 if scores[i] > high else 2 if scores[i] > mid else 3, ranks[i], i) for i in np.flatnonzero(scores > low)]
    cand.sort(key=lambda c: c[:2])
    if not cand:
        return [], [], label
    cell = (epochs[-1] - epochs[0]) / 35
    apart = max(gap, 0.5 * cell)
    taken: list[int] = []
    used: set[int] = set()
    at = epochs[0]
    while cell > 0 and at < epochs[-1]:
        best = next((i for _, _, i in cand if i not in used and at <= epochs[i] <= at + cell), None)
        if best is not None and all(abs(epochs[best] - epochs[k]) >= apart for k in taken):
            taken.append(best)
            used.add(best)
        at += cell
    if len(taken) < 25:
        for rank, _, i in cand:
            if rank <= 2 and i not in used and all(abs(epochs[i] - epochs[k]) >= gap for k in taken):
                taken.append(i)
                used.add(i)
                if len(taken) >= 40:
                    break
    taken.sort(key=lambda i: epochs[i])
    conf = {i: min(1.0, float(scores[i]) / 10) for i in taken}
    if len(taken) > 2:
        taken = sorted(sorted(taken, key=lambda i: -conf[i])[: most or 40], key=lambda i: epochs[i])
    return taken, [conf[i] for i in taken], label


def _grouped(series: DataFrame, find: Callable[[pd.DataFrame], tuple[list[int], list[float], str]]) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("epoch_us", kind="stable").reset_index(drop=True)
        places, conf, label = find(pdf)
        return pd.DataFrame({"series_id": [pdf.series_id.iloc[0]] * len(places), "epoch": pdf.epoch.to_numpy()[places] if places else [], "confidence": conf, "algorithm": [label] * len(places)}).astype({"series_id": object, "epoch": float, "confidence": float, "algorithm": object})

    return series.groupBy("series_id").applyInPandas(run, "series_id string, epoch double, confidence double, algorithm string")


def detect_pelt(series: DataFrame, model: str = "rbf", penalty: float = 10.0, threshold: float = 0.25, gap: float = 1800) -> DataFrame:
    """PELT change points of every series."""
    return _grouped(series.select("series_id", "epoch_us", "epoch", "rtt_value"), lambda p: pelt(p.epoch.to_numpy(), p.rtt_value.to_numpy(), model, penalty, threshold, gap))


def detect_bcp(series: DataFrame, threshold: float = 0.25) -> DataFrame:
    """Bayesian change points of every series."""
    return _grouped(series.select("series_id", "epoch_us", "epoch", "rtt_value"), lambda p: bcp(p.epoch.to_numpy(), p.rtt_value.to_numpy(), threshold))


def detect_welch(series: DataFrame, threshold: float = 0.25, gap: float = 1800, most: int | None = None) -> DataFrame:
    """Change points of the Welch statistic over a time grid; the statistics are made in SQL."""
    from .detectors import welch_scores

    scores = welch_scores(series).select("series_id", "epoch_us", "score")
    joined = series.select("series_id", "epoch_us", "epoch").join(scores, ["series_id", "epoch_us"], "left").select("series_id", "epoch_us", "epoch", F.coalesce("score", F.lit(0.0)).alias("score"))
    return _grouped(joined, lambda p: welch_grid(p.epoch.to_numpy(), p.score.to_numpy(), threshold, gap, most) if len(p) >= 10 else ([], [], "torch_statistical"))
