"""Streams whose rows come out of order, over several batches and restarts, against the sorted table."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from rillscope.operators import online
from rillscope.streaming import stream_change_points, stream_congestion, stream_jitter, stream_to_table

SAMPLES = "series_id string, epoch_us bigint, seq bigint, rtt_value double"
PERIODS = "series_id string, cp_idx bigint, start_epoch double, has_jump boolean, has_significant_jitter boolean"
S = 1_000_000


def fed(spark, tmp_path, batches, schema, step, name):
    """Each batch is a run of its own from the checkpoint that the one before left."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}-in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/{name}-in")
        stream_to_table(step(stream), f"{tmp_path}/{name}-out", f"{tmp_path}/{name}-c")
    return spark.read.parquet(f"{tmp_path}/{name}-out").where("series_id != 'end'").collect()


def test_jitter_out_of_order(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(s, t * S + int(rng.integers(S)), k, float(rng.integers(1, 90))) for k, (t, s) in enumerate((t, s) for t in range(120) for s in ("a", "b"))]
    rows[40] = (*rows[38][:2], 40, 3.0)  # a tie in time: the sequence number decides
    late = [r for r in rows if r[2] % 7 == 3]
    batches = [[], [], []]
    for r in rows:
        # Some rows come a batch later, which is less than the delay.
        batches[min(2, r[1] // (40 * S) + (r in late))].append(r)
    for b in batches:
        rng.shuffle(b)
    batches = [[(str(s), int(t), int(q), float(v)) for s, t, q, v in b] for b in batches]
    got = fed(spark, tmp_path, [*batches, [("end", 10**6 * S, 0, 1.0)], [("a", 5 * S, 999, 1.0)]], SAMPLES, lambda st: stream_jitter(st, "90 seconds"), "jitter")
    want = []
    for s in ("a", "b"):
        mine = sorted((r[1], r[2], r[3]) for r in rows if r[0] == s)
        want += [(s, t, q, v - u) for (_, _, u), (t, q, v) in zip(mine, mine[1:])]
    assert sorted((r.series_id, r.epoch_us, r.seq, r.jitter) for r in got) == sorted(want)


def test_congestion_out_of_order(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [("a", i, 100.0 * i + 1000, bool(rng.integers(2)), bool(rng.integers(2))) for i in range(60)]
    batches = [rows[0:20:2] + rows[30:40], rows[1:20:2] + rows[20:30], rows[40:], [("end", 0, 1e9, False, False)]]
    got = fed(spark, tmp_path, batches, PERIODS, lambda st: stream_congestion(st, "5000 seconds"), "state")
    want, now = [], False
    for _, i, _, jump, jitter in rows:
        now = (jitter or now) if jump else False
        want.append((i, now))
    assert sorted((r.cp_idx, r.is_congested) for r in got) == want


def level_shifts(seed, levels, size):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(m, 1, size) for m in levels])


def unpruned(x, hazard=1 / 250):
    """The recursion over all run lengths, nothing dropped: probabilities of the starts after each value."""
    starts, p, stats, out = [], np.zeros(0), [], []
    for t, v in enumerate(x):
        p = np.append(p * (1 - hazard), hazard if t else 1.0)
        starts.append(t)
        stats.append((0, x[0], 1.0))
        told = []
        for n, mean, beta in stats:
            a, k = 1 + n / 2, 1 + n
            scale = beta * (k + 1) / (a * k)
            told.append(math.exp(math.lgamma(a + 0.5) - math.lgamma(a)) / math.sqrt(2 * a * math.pi * scale) * (1 + (v - mean) ** 2 / (2 * a * scale)) ** (-a - 0.5))
        stats = [(n + 1, ((n + 1) * mean + v) / (n + 2), beta + (n + 1) * (v - mean) ** 2 / (2 * (n + 2))) for n, mean, beta in stats]
        p = p * np.array(told)
        p /= p.sum()
        out.append(p.copy())
    return out


def test_pruned_recursion_is_close():
    x = level_shifts(3, (10, 30, 12), 60)
    runs = online.Runs(online.Settings())
    for t, (v, want) in enumerate(zip(x, unpruned(x), strict=True)):
        runs.add(float(t), float(v))
        got = np.zeros(t + 1)
        got[runs.starts.astype(int)] = np.exp(runs.logs)
        assert np.abs(got - want).max() < 1e-4
    assert len(runs.starts) < 150


def test_state_is_bounded_and_found():
    x = np.tile(level_shifts(4, (10, 25), 100), 20)
    runs, found = online.Runs(online.Settings()), []
    for t, v in enumerate(x):
        if hit := runs.add(float(t), float(v)):
            found.append(hit[0])
        assert len(runs.starts) <= online.MOST
    assert found == [100.0 * k for k in range(1, 40)]
    few = online.Runs(online.Settings(most=10))
    for t, v in enumerate(x[:300]):
        few.add(float(t), float(v))
    assert len(few.starts) <= 10


def test_change_points_of_a_stream(spark, tmp_path):
    rows = [(s, (900 * i + 7) * S, i, float(v)) for s, seed in (("a", 5), ("b", 6)) for i, v in enumerate(level_shifts(seed, (10, 40, 12), 50))]
    want = sorted(tuple(r) for r in online.detect_online(spark.createDataFrame(rows, SAMPLES)).collect())
    assert {("a", 900.0 * 50 + 7), ("a", 900.0 * 100 + 7), ("b", 900.0 * 50 + 7)} <= {w[:2] for w in want}
    odd, even = [r for r in rows if r[2] % 2], [r for r in rows if not r[2] % 2]
    batches = [odd[:60], even[:70], odd[60:] + even[70:], [("end", 10**7 * S, 0, 1.0)]]
    got = fed(spark, tmp_path, batches, SAMPLES, lambda st: stream_change_points(st, "100 days"), "cps")
    assert sorted(tuple(r) for r in got) == want
    assert online.detect_online(spark.createDataFrame([], SAMPLES)).count() == 0


def test_idle_series_is_forgotten(spark, tmp_path):
    batches = [[("a", 1 * S, 1, 5.0)], [("end", 50 * S, 0, 1.0)], [("end", 500 * S, 1, 1.0)], [("end", 900 * S, 2, 1.0)], [("a", 1000 * S, 2, 9.0), ("a", 1001 * S, 3, 10.0)], [("end", 9000 * S, 3, 1.0)]]
    kept = fed(spark, tmp_path, batches, SAMPLES, lambda st: stream_jitter(st, "10 seconds"), "kept")
    forgotten = fed(spark, tmp_path, batches, SAMPLES, lambda st: stream_jitter(st, "10 seconds", 60), "idle")
    assert sorted(r.jitter for r in kept) == [1.0, 4.0] and [r.jitter for r in forgotten] == [1.0]


def test_session_setting_comes_back(spark):
    from rillscope.streaming.ordered import PROVIDER, state_store

    before = spark.conf.get(PROVIDER[0], None)
    with state_store(spark):
        assert spark.conf.get(PROVIDER[0]) == PROVIDER[1]
    assert spark.conf.get(PROVIDER[0], None) == before
    assert spark.range(1).select(F.lit(1)).count() == 1
