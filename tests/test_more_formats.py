"""Files as series, further output formats, agreement by series, and a published example where one is at hand."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from rillscope.functions.table import register_functions
from rillscope.operators import inference, periods, sequential, summary, windows
from rillscope.plans.pipeline import DETECTORS
from rillscope.sinks import detailed_json, minimal_json, save, time_series_json
from rillscope.sources import read_path

from .test_formats_streams import _inferences


def test_json_files_as_series(spark, tmp_path):
    for name, rtt in (("one", 5.0), ("two", 6.0)):
        lines = [{"type": "ping", "src": "s", "dst": "d", "responses": [{"rtt": rtt + k, "tx": {"sec": 10 + k, "usec": 0}} for k in range(3)]}]
        (tmp_path / f"{name}.json").write_text("\n".join(map(json.dumps, lines)))
    got = read_path(spark, f"{tmp_path}/*.json", per_file=True).collect()
    assert sorted((r.series_id.rsplit("/", 1)[1], r.rtt_value) for r in got) == [("one.json", 5.0 + k) for k in range(3)] + [("two.json", 6.0 + k) for k in range(3)]
    (tmp_path / "a.influx").write_text("ping rtt=5 1000000000\n")
    (tmp_path / "b.influx").write_text("ping rtt=6 1000000000\n")
    assert read_path(spark, f"{tmp_path}/*.influx", "influx", per_file=True).select("series_id").distinct().count() == 2


def test_objects_by_series(spark, tmp_path):
    inf, meta = _inferences(spark), spark.createDataFrame([(7, "adtk")], "measurements bigint, algorithm string")
    small = json.loads(minimal_json(inf).first().value)
    assert small["congestion_periods"][0] == {"start": 0.0, "end": 60.0, "congested": True, "confidence": 0.9} and small["summary"] == {"total": 2, "congested": 1, "duration": 60.0}
    full = json.loads(detailed_json(inf, meta).first().value)
    first, second = full["analysis_results"]
    assert first["time_period"]["duration_minutes"] == 1.0 and first["jitter_analysis"]["method"] == "jitter_dispersion" and "method" not in second["jitter_analysis"]
    assert full["metadata"] == {"measurements": 7, "algorithm": "adtk"}
    arrays = json.loads(time_series_json(inf).first().value)
    assert arrays["congestion_status"] == [True, False] and arrays["latency_jumps"] == [2.0, -1.0] and arrays["jitter_metrics"] == [0.4, 0.0]
    for kind in ("minimal", "detailed", "time-series"):
        save(inf, f"{tmp_path}/{kind}", kind, metadata=meta)
        assert spark.read.text(f"{tmp_path}/{kind}").count() == 1
    save(inf, f"{tmp_path}/p", "parquet", full=True, metadata=meta)
    assert {(r.total_measurements, r.algorithm_used, r.jitter_method) for r in spark.read.parquet(f"{tmp_path}/p").collect()} == {(7, "adtk", "jitter_dispersion"), (7, "adtk", None)}
    with pytest.raises(ValueError):
        save(inf, f"{tmp_path}/q", "detailed")


def test_agreement_by_series(spark):
    spans = "series_id string, start_epoch double, end_epoch double"
    found = spark.createDataFrame([("a", 0.0, 200_000.0), ("b", 0.0, 10.0), ("c", 0.0, 10.0)], spans)
    truth = spark.createDataFrame([("a", 100_000.0, 300_000.0), ("b", 20.0, 30.0), ("d", 0.0, 5.0)], spans)
    got = {r.series_id: (r.precision, r.recall, r.f1) for r in summary.overlap(found, truth, "series_id").collect()}
    assert got == {"a": (0.5, 0.5, 0.5), "b": (0.0, 0.0, None), "c": (0.0, None, None), "d": (None, 0.0, None)}
    assert [tuple(r) for r in summary.overlap(found.limit(0), truth.limit(0)).collect()] == [(None, None, None)]


def test_sql_detector_is_the_detector(spark, small_dir):
    from rillscope.schema import events_as_samples

    minima = windows.min_intervals(events_as_samples(spark, small_dir))
    register_functions(spark)
    minima.createOrReplaceTempView("few_minima")
    by_sql = spark.sql("SELECT * FROM rill_detect_pelt('l2', TABLE(few_minima) PARTITION BY series_id)")
    assert sorted(tuple(r) for r in by_sql.collect()) == sorted(tuple(r)[:3] for r in sequential.detect_pelt(minima, "l2").collect())


@pytest.mark.skipif("EXAMPLE_MINIMA" not in os.environ, reason="EXAMPLE_MINIMA names no published series of minima (CSV: epoch, values)")
def test_published_example(spark):
    """Numbers of change points as published for the example series, and the states of its expected periods (EXAMPLE_PERIODS) from their bounds alone."""
    from rillscope.config import ChangePoints

    minima = read_path(spark, os.environ["EXAMPLE_MINIMA"], "csv")
    counts = {name: find(minima, ChangePoints()).count() for name, find in DETECTORS.items()}
    assert counts == {"ruptures": 24, "bcp": 36, "torch": 28, "rbeast": 40, "adtk": 35}
    expected = spark.read.option("header", True).schema("starts double, ends double, congestion double").csv(os.environ["EXAMPLE_PERIODS"])
    bounds = expected.select(F.explode(F.array("starts", "ends")).alias("epoch")).distinct().select(F.lit("all").alias("series_id"), "epoch", F.lit(1.0).alias("confidence"))
    spans = periods.periods_from_change_points(bounds)
    ev = inference.evidence(periods.latency_jumps(minima, spans), periods.dispersion_periods(windows.jitter_dispersion(minima), spans))
    both = inference.congestion(ev).join(expected.withColumnRenamed("starts", "start_epoch"), "start_epoch")
    assert both.count() == 28 and both.where("is_congested != (congestion = 1)").count() == 0
