"""Choices made in ranges at once against loops over the whole series, and the detectors' costs against their definitions."""

from __future__ import annotations

import numpy as np
import pytest

from rillscope.operators import folds, inference, sequential

CANDIDATES = "series_id string, epoch double, confidence double"


def in_turn(rows, gap, surest):
    kept: list = []
    for e, c in sorted(rows):
        if not kept or e - kept[-1][0] >= gap:
            kept.append((e, c))
        elif surest and c > kept[-1][1]:
            kept[-1] = (e, c)
    return kept


@pytest.mark.parametrize("surest", [False, True])
@pytest.mark.parametrize("span", [250.0, 1000.0, 1e9])
def test_kept_in_ranges(spark, surest, span):
    rng = np.random.default_rng(int(span) % 97 + surest)
    rows = {f"s{k}": [(float(e), float(c)) for e, c in zip(rng.integers(0, 9000, 40 * k + 1) * (0.5 if k % 2 else 1.0), np.round(rng.random(40 * k + 1), 1 + k % 3), strict=True)] for k in range(8)}
    rows["rising"] = [(10.0 * i, i / 1000) for i in range(900)]  # each gives way to the next, over many ranges
    rows["falling"] = [(10.0 * i, 1 - i / 1000) for i in range(900)]
    rows["sparse"] = [(3000.0 * i + 1.7e9, 0.5) for i in range(5)]
    df = spark.createDataFrame([(s, *r) for s, rs in rows.items() for r in rs], CANDIDATES).repartition(3)
    got = sorted(tuple(r) for r in folds.keep_apart(df, 100, surest, span).collect())
    assert got == sorted((s, *k) for s, rs in rows.items() for k in in_turn(rs, 100, surest))
    assert folds.keep_apart(df.limit(0), 100, surest).count() == 0


def test_borders_of_a_gap():
    epoch = np.array([0.1, 0.3, 0.7, 1.1, 1.3])
    nxt, _ = folds.successors(epoch, np.zeros(5), 0.4)
    assert nxt.tolist() == [next((k for k in range(i + 1, 5) if epoch[k] - epoch[i] >= 0.4), 5) for i in range(5)]


@pytest.mark.parametrize("span", [None, 5])
def test_flips_in_ranges(spark, span):
    rng = np.random.default_rng(3)
    rows = [(f"s{k}", float(i), float(i + 1), i, bool(rng.random() < 0.5), 0.9) for k in range(6) for i in range(1 + 17 * k)]
    df = spark.createDataFrame(rows, "series_id string, start_epoch double, end_epoch double, cp_idx int, is_congested boolean, confidence double").repartition(3)
    want = []
    for k in range(6):
        mine = [list(r) for r in rows if r[0] == f"s{k}"]
        for i in range(1, len(mine) - 1):
            if mine[i][4] != mine[i - 1][4] and mine[i][4] != mine[i + 1][4]:
                mine[i][4:] = [not mine[i][4], 0.3]
        want += [tuple(r) for r in mine]
    assert sorted(tuple(r) for r in inference.smoothed(df, span).collect()) == sorted(want)


@pytest.mark.parametrize("span", [None, 4])
def test_state_in_ranges(spark, span):
    rng = np.random.default_rng(4)
    rows = [("a", i, float(i), bool(rng.random() < 0.7), bool(rng.random() < 0.3), 1.0, 0.5) for i in range(60)]
    df = spark.createDataFrame(rows, "series_id string, cp_idx int, start_epoch double, has_jump boolean, has_significant_jitter boolean, magnitude double, threshold double")
    want, now = [], False
    for r in rows:
        now = (r[4] or now) if r[3] else False
        want.append(now)
    assert [r.is_congested for r in inference.congestion(df, span).orderBy("cp_idx").collect()] == want


def kernel(x):
    d = (x[:, None] - x[None, :]) ** 2
    middle = np.median(d[np.triu_indices(len(x), 1)])
    return np.exp(-np.clip(d / middle if middle > 0 else d, 1e-2, 1e2))


def plain_cost(x, model, a, e):
    s = x[a:e]
    if model == "l1":
        return np.abs(s - np.median(s)).sum()
    if model == "rbf":
        k = kernel(x)[a:e, a:e]
        return np.diagonal(k).sum() - k.sum() / len(s)
    return len(s) * s.var() if model == "l2" else len(s) * np.log(max(s.var(), 1e-8))


@pytest.mark.parametrize("model", ["l1", "l2", "normal", "rbf"])
def test_costs(model):
    rng = np.random.default_rng(5)
    for x in (rng.normal(20, 3, 83), np.round(rng.normal(20, 3, 64)), np.full(31, 4.0)):
        cost, live = sequential.segment_cost(x, model), np.array([0])
        for e in range(5, len(x), 5):
            ok = e - live >= 2
            got = cost.at(live, ok, e)
            assert np.allclose(got, [plain_cost(x, model, a, e) for a in live[ok]], atol=1e-7)
            keep = rng.random(len(live)) < 0.8  # some starts are pruned
            keep[-1] = True
            live = np.append(live[keep], e)


def test_long_series_take_seconds():
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(10 + 5 * (k % 3), 1 + k % 2, 200) for k in range(125)])
    edges = set(range(200, 25_000, 200))
    for model in ("l1", "rbf"):
        found = sequential.optimal_partition(x, 20.0 if model == "l1" else 7.5, model)
        assert len(found) >= 100 and sum(min(abs(f - e) for e in edges) <= 10 for f in found) >= 0.9 * len(found)
    p = sequential.change_probabilities(x)
    assert (p > 0.25).sum() >= 100


def test_truncated_messages_are_the_whole_ones():
    rng = np.random.default_rng(7)
    for x in (np.concatenate([rng.normal(m, s, 400) for m, s in ((10, 1), (14, 3), (9, 1))]), rng.normal(0, 1, 900), np.full(700, 3.0), np.concatenate([rng.normal(m, 0.2, 60) for m in range(15)])):
        assert np.abs(sequential.change_probabilities(x) - sequential.change_probabilities(x, truncate=False)).max() < 1e-9


def test_messages_rise_again_far_off():
    """Small values make long segments likelier than all shorter ones, by more than a nearby stop would see."""
    x = np.full(1500, 0.05)
    p = sequential.change_probabilities(x)
    assert np.abs(p - sequential.change_probabilities(x, truncate=False)).max() < 1e-9
    assert p.max() < 0.25


def test_comparison_of_detectors_on_small_values(spark):
    from rillscope.config import ChangePoints
    from rillscope.plans.pipeline import compare

    rows = [("a", i * 900_000_000, i * 900.0, 0.05) for i in range(1500)]
    m = spark.createDataFrame(rows, "series_id string, epoch_us bigint, epoch double, rtt_value double")
    assert compare(m, ChangePoints(), ["bcp"]).count() == 0


def test_grid_takes_the_earlier_of_equal_scores():
    """Equal scores come out of the sums with different last digits."""
    epochs, scores = np.arange(700) * 900.0, np.zeros(700)
    scores[[205, 206]] = 1.5, 1.5 * (1 + 1e-13)
    scores[[405, 406]] = 1.5, 1.5 * (1 + 1e-6)
    assert sequential.welch_grid(epochs, scores)[0] == [205, 406]
    assert sequential.score_ranks(np.array([1.0, 2.0, 2.0 + 1e-12, 0.0, 0.0])).tolist() == [1, 0, 0, 2, 2]
    assert not len(sequential.score_ranks(np.zeros(0)))
