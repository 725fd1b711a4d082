"""Exact quantiles, windows in ranges, as-of periods and the test statistic against numpy, and their plans."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillscope.operators import detectors, periods, quantiles, ranges, windows

SHARES = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]


def keyed(rng):
    yield "normal", rng.normal(20, 5, 3000)
    yield "one value", np.full(2000, 7.25)
    yield "two values", rng.choice([1.0, 1e9], 999)
    yield "ties", rng.integers(0, 5, 4000).astype(float)
    yield "signs", rng.normal(0, 1, 501)
    yield "wide", np.concatenate([10.0 ** rng.uniform(-300, 300, 800), -(10.0 ** rng.uniform(-300, 300, 800)), [0.0]])
    yield "close", 20 + np.arange(1000) * 1e-13
    yield "single", np.array([3.5])
    yield "pair", np.array([-1.0, 4.0])
    yield "extreme", np.array([-1.7e308, -1.0, 0.0, 1.0, 1.7e308])


@pytest.mark.parametrize("small", [10_000, 0])
def test_exact_quantiles(spark, monkeypatch, small):
    monkeypatch.setattr(quantiles, "SMALL", small)
    monkeypatch.setattr(quantiles, "PARTS", 4096 if small else 64)
    data = dict(keyed(np.random.default_rng(0)))
    rows = [(k, 1, float(v)) for k, x in data.items() for v in x] + [("normal", 1, None), ("normal", 1, float("nan")), ("nothing", 1, None)]
    df = spark.createDataFrame(rows, "series_id string, part int, x double").repartition(5)
    got = {(r.series_id, r.share): r.value for r in quantiles.exact_quantiles(df, "x", SHARES, ["series_id", "part"]).collect()}
    assert set(got) == {(k, s) for k in data for s in SHARES}
    for k, x in data.items():
        x = np.sort(x)
        for s in SHARES:
            place = (len(x) - 1) * s
            low, high = x[int(np.floor(place))], x[int(np.ceil(place))]
            assert got[k, s] == low + (high - low) * (place - np.floor(place)), (k, s)
    assert quantiles.exact_quantiles(df.limit(0), "x", [0.5], ["series_id"]).count() == 0


def series(spark, names=("a", "b"), n=700, seed=1, gap=True):
    rng = np.random.default_rng(seed)
    rows = {}
    for k, name in enumerate(names):
        at = np.cumsum(rng.integers(1, 5, n + 13 * k)) * 900_000_000
        if gap:
            at[n // 2 :] += 40 * ranges.STRETCH_US  # stretches without rows
        rows[name] = [(name, int(t), int(t) / 1e6, float(v)) for t, v in zip(at, rng.gamma(3, 5, len(at)), strict=True)]
    return rows, spark.createDataFrame([r for rs in rows.values() for r in rs], "series_id string, epoch_us bigint, epoch double, rtt_value double").repartition(4)


@pytest.fixture
def short_ranges(monkeypatch):
    """Ranges and stretches of a few rows, so that every window crosses them."""
    monkeypatch.setattr(ranges.with_halo, "__defaults__", (7,))
    for f in (ranges.placed, ranges.stretches):
        monkeypatch.setattr(f, "__defaults__", (20 * 900_000_000,))
    monkeypatch.setattr(windows, "STRETCH_US", 20 * 900_000_000)


def dispersion(x, k=4, m=6):
    j = np.diff(x)
    iqr = np.array([np.subtract(*np.percentile(j[i - k : i + k + 1], [75, 25])) for i in range(k, len(j) - k)])
    return np.convolve(iqr, np.ones(m) / m, "valid")


def test_windows_in_ranges(spark, short_ranges):
    rows, df = series(spark)
    rows["c"] = [("c", 900_000_000 * i, 900.0 * i, 5.0 + i % 3) for i in range(15)]
    rows["short"] = [("short", 0, 0.0, 1.0), ("short", 900_000_000, 900.0, 4.0)]
    df = df.unionByName(spark.createDataFrame(rows["c"] + rows["short"], df.schema))
    disp = {(r.series_id, r.epoch_us): r.dispersion for r in windows.jitter_dispersion(df).collect()}
    jit = windows.jitter(df)
    jits = {(r.series_id, r.epoch_us): r.jitter for r in jit.collect()}
    iqr = {(r.series_id, r.epoch_us): r.iqr for r in windows.moving_iqr(jit).collect()}
    mean = {(r.series_id, r.epoch_us): r.average for r in windows.moving_average(jit, "jitter").collect()}
    numbered = {(r.series_id, r.epoch_us): (r.i, r.n) for r in windows.indexed(df).collect()}
    seen = [0, 0, 0, 0]
    for name, rs in rows.items():
        x, at = np.array([r[3] for r in rs]), [(name, r[1]) for r in rs]
        assert [numbered[a] for a in at] == [(i, len(x)) for i in range(len(x))]
        j = np.diff(x)
        assert np.allclose([jits[a] for a in at[1:]], j)
        for got, want, first, place in ((disp, dispersion(x) if len(x) > 14 else [], 1 + 4 + 3, 0), (iqr, [np.subtract(*np.percentile(j[i - 4 : i + 5], [75, 25])) for i in range(4, len(j) - 4)], 5, 1), (mean, np.convolve(j, np.ones(6) / 6, "valid") if len(j) >= 6 else [], 4, 2)):
            mine = at[first : first + len(want)]
            assert np.allclose([got[a] for a in mine], want)
            seen[place] += len(want)
    assert [len(disp), len(iqr), len(mean)] == seen[:3]


def test_two_sided_sums_in_ranges(spark, short_ranges):
    rows, df = series(spark, n=200)
    found = detectors.two_sided(df, F.lit(20), F.lit(True)).collect()
    want = {(name, i): x for name, rs in rows.items() for x in [np.array([r[3] for r in rs])] for i in range(20, len(x) - 19)}
    assert {(r.series_id, r.i) for r in found} == set(want)
    for r in found:
        x, i = want[r.series_id, r.i], r.i
        left, right = x[i - 20 : i], x[i : i + 20]
        assert np.allclose([r.mean_l + x.mean(), r.mean_r + x.mean(), r.var_l, r.var_r], [left.mean(), right.mean(), left.var(), right.var()], atol=1e-9)


def brute_periods(rows, spans):
    out = []
    for name, at, epoch, value in rows:
        for s in spans:
            if s[0] == name and s[2] <= epoch <= s[4]:
                out.append((name, at, value, s[1], epoch >= s[3]))
    return sorted(out)


@pytest.mark.parametrize("missing", [False, True])
def test_values_in_periods(spark, missing):
    rows, df = series(spark, n=300)
    rng = np.random.default_rng(2)
    cps = [(name, rs[i][2] + (0.0 if k % 3 else 1.5), 1.0) for name, rs in rows.items() for k, i in enumerate(sorted(rng.choice(len(rs), 12, replace=False).tolist()))]
    spans = periods.periods_from_change_points(spark.createDataFrame(cps, "series_id string, epoch double, confidence double"))
    if missing:
        spans = spans.where("cp_idx % 4 != 1")
    got = sorted((r.series_id, r.epoch_us, r.rtt_value, r.cp_idx, r.current) for r in periods.in_periods(df, spans).collect())
    want = brute_periods([r for rs in rows.values() for r in rs], [tuple(r) for r in spans.collect()])
    assert got == want and len(got) > 500
    assert periods.in_periods(df.limit(0), spans).count() == 0 and periods.in_periods(df, spans.limit(0)).count() == 0


def test_statistic_by_value(spark):
    rng = np.random.default_rng(3)
    rows = [("a", i * 10**6, float(i), float(v)) for i, v in enumerate(np.round(np.concatenate([rng.normal(0, s, 150) for s in (1, 3, 0.1, 2)]), 1))]
    jit = spark.createDataFrame(rows, "series_id string, epoch_us bigint, epoch double, jitter double")
    cps = spark.createDataFrame([("a", float(e), 1.0) for e in (0, 150, 300, 450, 599)], "series_id string, epoch double, confidence double")
    x = np.array([r[3] for r in rows])
    for r in periods.ks_statistics(jit, periods.periods_from_change_points(cps)).collect():
        s, e = int(r.start_epoch), int(r.end_epoch)
        now, before = x[s : e + 1], x[s - 150 : s]
        at = np.unique(np.concatenate((now, before)))
        want = np.abs(np.searchsorted(np.sort(now), at, "right") / len(now) - np.searchsorted(np.sort(before), at, "right") / len(before)).max()
        assert (r.n_now, r.n_before) == (len(now), len(before)) and r.statistic == pytest.approx(want, abs=1e-12)


def test_no_task_takes_a_whole_series(spark):
    """One series of ten million bins: what is dealt out by series alone has been aggregated before."""
    long = spark.range(10_000_000).select(F.when(F.col("id") >= 0, "a").alias("series_id"), (F.col("id") * 900_000_000).alias("epoch_us"), (F.col("id") * 900.0).alias("epoch"), F.rand(1).alias("rtt_value"))
    spans = spark.createDataFrame([("a", k, 1e6 * (k - 1), 1e6 * k, 1e6 * (k + 1)) for k in range(1, 50)], "series_id string, cp_idx int, prev_epoch double, start_epoch double, end_epoch double")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (windows.jitter_dispersion(long), detectors.level_shift_scores(long), detectors.welch_scores(long), windows.indexed(long), periods.in_periods(long, spans))]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    for plan in plans:
        lines = plan.split("\n")
        alone = [k for k, line in enumerate(lines) if "Reused" not in line and re.search(r"Exchange hashpartitioning\(series_id#\d+, \d+\)", line)]
        # Below it stands an aggregate: partial, or by (series, stretch of time).
        whole = [lines[k : k + 8] for k in alone if not re.search("Aggregate", "".join(lines[k + 1 : k + 6]))]
        assert not whole
        assert "Pandas" not in plan and "Arrow" not in plan


def test_long_series_runs(spark):
    long = spark.range(400_000).select(F.when(F.col("id") >= 0, "a").alias("series_id"), (F.col("id") * 900_000_000).alias("epoch_us"), (F.col("id") * 900.0).alias("epoch"), (10 + F.col("id") % 7).cast("double").alias("rtt_value"))
    assert windows.jitter_dispersion(long).count() == 400_000 - 14
    assert windows.indexed(long).agg(F.max("i"), F.sum("i"), F.max("n")).first()[:] == (399_999, 399_999 * 200_000, 400_000)
