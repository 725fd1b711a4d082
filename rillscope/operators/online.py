"""Change points as the values arrive, by a Bayesian recursion over run lengths.

Each hypothesis is a time at which the present run began, with its probability
and the Normal-Gamma posterior of that run.  A value updates all of them: with
the probability ``hazard`` a new run begins at it, otherwise a run goes on, each
weighed by the Student-t probability that it gave the value.  Hypotheses below
``PRUNE`` times the likeliest are dropped, and the least likely beyond MOST, so
the state of a series stays small however long the series is.  The first drops
less than (number of hypotheses) * PRUNE of the probability at a value, the
second is for series that fit no run at all.

A change point is reported once the runs that began after the last one reported
hold ``level`` of the probability and the likeliest of them has ``least`` values.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

PRUNE = 1e-6
MOST = 400
OUT = "series_id string, epoch double, confidence double, detected_epoch double"
STATE = "prior double, accepted double, starts array<double>, logs array<double>, counts array<bigint>, means array<double>, betas array<double>"


@dataclass(frozen=True)
class Settings:
    """One change in 1/hazard values is expected."""

    hazard: float = 1 / 250
    level: float = 0.9
    least: int = 5
    prune: float = PRUNE
    most: int = MOST


@dataclass
class Runs:
    """The hypotheses of one series."""

    settings: Settings
    prior: float | None = None  # mean that a new run is expected to have: the first value
    accepted: float = 0.0
    starts: np.ndarray = field(default_factory=lambda: np.zeros(0))
    logs: np.ndarray = field(default_factory=lambda: np.zeros(0))
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    means: np.ndarray = field(default_factory=lambda: np.zeros(0))
    betas: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @classmethod
    def load(cls, settings: Settings, state: tuple | None) -> Runs:
        if state is None:
            return cls(settings)
        prior, accepted, starts, logs, counts, means, betas = state
        return cls(settings, prior, accepted, np.array(starts, float), np.array(logs, float), np.array(counts, np.int64), np.array(means, float), np.array(betas, float))

    def dump(self) -> tuple:
        return (self.prior, self.accepted, *(getattr(self, c).tolist() for c in ("starts", "logs", "counts", "means", "betas")))

    def add(self, epoch: float, x: float) -> tuple[float, float] | None:
        """Take a value; (epoch, confidence) of a change point that it settles."""
        c = self.settings
        if self.prior is None:
            self.prior, self.accepted = x, epoch
            logs = np.zeros(1)
        else:
            logs = np.append(self.logs + math.log1p(-c.hazard), math.log(c.hazard))
        starts, n = np.append(self.starts, epoch), np.append(self.counts, 0)
        mean, beta = np.append(self.means, self.prior), np.append(self.betas, 1.0)
        alpha, kappa = 1 + n / 2, 1.0 + n
        spread = 2 * beta * (kappa + 1) / kappa  # two alpha times the squared scale
        off = x - mean
        gammas = np.array([math.lgamma(a + 0.5) - math.lgamma(a) for a in alpha.tolist()])
        logs = logs + gammas - 0.5 * np.log(math.pi * spread) - (alpha + 0.5) * np.log1p(off * off / spread)
        beta, mean, n = beta + kappa * off * off / (2 * (kappa + 1)), (kappa * mean + x) / (kappa + 1), n + 1
        keep = logs >= logs.max() + math.log(c.prune)
        if keep.sum() > c.most:
            keep = np.zeros(len(logs), bool)
            keep[np.sort(np.argsort(-logs, kind="stable")[: c.most])] = True
        starts, logs, n, mean, beta = starts[keep], logs[keep], n[keep], mean[keep], beta[keep]
        top = logs.max()
        logs = logs - (top + math.log(np.exp(logs - top).sum()))
        self.starts, self.logs, self.counts, self.means, self.betas = starts, logs, n, mean, beta
        best = int(np.argmax(logs))
        after = float(np.exp(logs[starts > self.accepted]).sum())
        if after < c.level or n[best] < c.least or starts[best] <= self.accepted:
            return None
        self.accepted = float(starts[best])
        return self.accepted, min(1.0, after)


def online_step(settings: Settings, series_id: str, rows: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple]:
    """Change points that ``rows`` (in time order) settle, and the state after them."""
    runs = Runs.load(settings, state)
    found = [(series_id, *hit, e) for e, x in zip(rows.epoch_us.to_numpy() / 1e6, rows.rtt_value.to_numpy(), strict=True) if (hit := runs.add(float(e), float(x)))]
    return pd.DataFrame(found, columns=["series_id", "epoch", "confidence", "detected_epoch"]).astype({"series_id": object, "epoch": float, "confidence": float, "detected_epoch": float}), runs.dump()


def detect_online(series: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(series_id, epoch, confidence, detected_epoch) of whole series, by the recursion that a stream carries on."""
    c = settings or Settings()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return online_step(c, pdf.series_id.iloc[0], pdf.sort_values("epoch_us", kind="stable"), None)[0]

    return series.select("series_id", "epoch_us", "rtt_value").groupBy("series_id").applyInPandas(run, OUT)
