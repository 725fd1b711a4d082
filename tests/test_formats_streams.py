"""Typed CSV, output formats, folds, table functions and state that streams carry."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

import rillscope
from rillscope.functions import ks
from rillscope.functions.table import register_functions
from rillscope.operators import detectors, inference, summary
from rillscope.sinks import save
from rillscope.sources import read_csv, read_path
from rillscope.streaming import stream_min_intervals, stream_to_table


def test_typed_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("epoch,values,source\n10,5.5,x\n20,oops,y\n30,0,z\n")
    (tmp_path / "b.csv").write_text("epoch,values,source\n40,7,x\n")
    rows = read_csv(spark, f"{tmp_path}/*.csv").collect()
    assert sorted((r.epoch, r.rtt_value, r.source) for r in rows) == [(10.0, 5.5, "x"), (40.0, 7.0, "x")]
    with pytest.raises(Exception, match="(?i)malformed|range"):
        read_csv(spark, f"{tmp_path}/a.csv", "strict").collect()
    by_file = read_path(spark, f"{tmp_path}/*.csv", "csv", per_file=True).groupBy("series_id").count().collect()
    assert len(by_file) == 2


def _inferences(spark):
    rows = [("a", 1, 0.0, 60.0, True, 0.9, (True, 2.0, 0.5), (True, 0.4, "jitter_dispersion", 0.25, None)), ("a", 2, 60.0, 90.0, False, 0.0, (False, -1.0, 0.5), None)]
    schema = "series_id string, cp_idx int, start_epoch double, end_epoch double, is_congested boolean, confidence double, latency_jump struct<has_jump: boolean, magnitude: double, threshold: double>, jitter_analysis struct<has_significant_jitter: boolean, jitter_metric: double, method: string, threshold: double, p_value: double>"
    return spark.createDataFrame(rows, schema)


def test_saved_formats(spark, tmp_path):
    inf, meta = _inferences(spark), spark.createDataFrame([("adtk",)], "algorithm string")
    save(inf, f"{tmp_path}/nested", metadata=meta)
    (line,) = [r.value for r in spark.read.text(f"{tmp_path}/nested").collect()]
    made = json.loads(line)
    assert made["series_id"] == "a" and len(made["inferences"]) == 2 and made["metadata"] == {"algorithm": "adtk"}
    for kind in ("json", "csv", "parquet", "xml", "yaml"):
        save(inf, f"{tmp_path}/{kind}", kind, full=True)
    assert spark.read.text(f"{tmp_path}/json").count() == 2
    assert all("<period>" in r.value for r in spark.read.text(f"{tmp_path}/xml").where("value like '%jump_magnitude%'").collect())
    assert json.loads(spark.read.text(f"{tmp_path}/yaml").first().value[2:])["jump_magnitude"] in (2.0, -1.0)
    with pytest.raises(ValueError):
        save(inf, f"{tmp_path}/x", "other")


def test_folds(spark):
    rng = np.random.default_rng(0)
    rows = [(f"s{k}", float(e), float(c)) for k in range(3) for e, c in zip(np.sort(rng.integers(0, 5000, 80)), rng.random(80), strict=True)]
    df = spark.createDataFrame(rows, "series_id string, epoch double, confidence double")
    got = sorted((r.series_id, r.epoch, r.confidence) for r in detectors.filter_change_points(df, 100).collect())
    want = []
    for s in ("s0", "s1", "s2"):
        kept: list = []
        for e, c in sorted((e, c) for k, e, c in rows if k == s):
            if not kept or e - kept[-1][0] >= 100:
                kept.append((e, c))
            elif c > kept[-1][1]:
                kept[-1] = (e, c)
        want += [(s, *k) for k in kept]
    assert got == sorted(want)
    flips = spark.createDataFrame([("a", float(i), float(i + 1), i, bool(b), 0.9) for i, b in enumerate([0, 1, 0, 1, 1, 0, 0, 1])], "series_id string, start_epoch double, end_epoch double, cp_idx int, is_congested boolean, confidence double")
    assert [r.is_congested for r in inference.smoothed(flips).orderBy("cp_idx").collect()] == [False, False, False, True, True, False, False, True]


def test_histogram_of_equal_values(spark):
    df = spark.createDataFrame([(1.0,), (1.0,)], "v double")
    assert [tuple(r) for r in summary.histogram(df, F.col("v")).collect()] == [(0, 2)]
    assert summary.histogram(df.limit(0), F.col("v")).count() == 0


def test_exact_p_of_large_samples():
    assert ks.p_value(0.05, 3000, 3000) == pytest.approx(ks.exact_p(0.05, 3000, 3000))
    assert ks.p_value(0.05, 3000, 3000) != ks.asymptotic_p(0.05, 3000, 3000)
    assert ks.p_value(0.5, 10_001, 5) == ks.asymptotic_p(0.5, 10_001, 5)


def test_table_function_detects(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(m, 1, 40) for m in (10, 40, 15)])
    minima = spark.createDataFrame([("a", int(i) * 900_000_000, float(i) * 900, float(v)) for i, v in enumerate(x)], "series_id string, epoch_us bigint, epoch double, rtt_value double")
    register_functions(spark)
    minima.createOrReplaceTempView("some_minima")
    found = {r.epoch / 900 for r in spark.sql("SELECT * FROM rill_detect_pelt('l2', TABLE(some_minima) PARTITION BY series_id)").collect()}
    assert {40.0, 80.0} <= found


def test_late_rows_are_left_out(spark, tmp_path):
    schema = "series_id string, ts timestamp, rtt_value double"
    batches = [[("a", 0, 5.0), ("a", 7200, 6.0)], [("a", 10, 1.0), ("a", 7300, 4.0)], [("a", 90_000, 9.0)], [("a", 200_000, 9.0)]]
    for rows in batches:
        df = spark.createDataFrame(rows, "series_id string, s bigint, rtt_value double").select("series_id", F.timestamp_seconds("s").alias("ts"), "rtt_value")
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream_to_table(stream_min_intervals(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/c")
    got = {r.bin_us // 1_000_000: r.rtt_value for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got[0] == 5.0 and got[7200] == 4.0  # the row at 10 s came two hours late


def test_exports():
    from rillscope.plans.pipeline import Pipeline

    assert rillscope.Pipeline is Pipeline and "Config" in rillscope.__all__
    with pytest.raises(AttributeError):
        _ = rillscope.nothing


def test_flagship_detects_once(spark, small_dir, monkeypatch):
    from rillscope.config import Config
    from rillscope.plans import pipeline
    from rillscope.schema import events_as_samples

    calls = []
    find = pipeline.DETECTORS["adtk"]
    monkeypatch.setitem(pipeline.DETECTORS, "adtk", lambda m, c: calls.append(1) or find(m, c))
    out = pipeline.Pipeline(spark, Config().merged({"change_point_detection": {"algorithm": "adtk"}})).run(events_as_samples(spark, small_dir)).inferences
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert calls == [1] and "Arrow" not in plan and "Pandas" not in plan
