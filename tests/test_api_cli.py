"""Request functions and the command line."""

from __future__ import annotations

import json

import numpy as np

from rillscope import api, cli


def request(n=200):
    rng = np.random.default_rng(1)
    x = np.where(np.arange(n) < n // 2, 20.0, 35.0) + rng.normal(0, 1, n)
    return {"data": {"measurements": [{"epoch": i * 900.0, "rtt_value": float(v)} for i, v in enumerate(x)]}}


def test_requests(spark):
    r = api.analyze(spark, request() | {"algorithm": "torch", "threshold": 0.25})
    assert r["success"] and r["change_points"] and r["metadata"]["measurements"] == 200
    assert len(r["inferences"]) <= max(len(r["change_points"]) - 2, 0)
    assert api.validate(spark, request())["metrics"]["total"] == 200
    out = api.compare_algorithms(spark, request() | {"algorithms": ["adtk", "rbeast"]})
    assert set(out["results"]) == {"adtk", "rbeast"}
    bad = api.analyze(spark, {"data": {"measurements": [{"epoch": 1, "rtt_value": -1}]}})
    assert not bad["success"] and "range" in bad["error"]
    assert not api.analyze(spark, request() | {"algorithm": "nope"})["success"]


def test_lists(spark):
    assert "ruptures" in api.algorithms() and "ks_test" in api.methods()
    assert api.config_template()["latency_jump"]["threshold"] == 0.5
    assert api.health(spark)["status"] == "healthy"
    assert api.recommend({"uncertainty": "yes"})[0][0] == "bcp"


def test_command_line(spark, tmp_path, capsys):
    assert cli.main(["version"]) == 0
    settings = tmp_path / "c.json"
    assert cli.main(["config", "--template", str(settings)]) == 0 and json.loads(settings.read_text())["output_format"] == "json"
    csv = tmp_path / "a.csv"
    csv.write_text("epoch,values\n" + "\n".join(f"{m['epoch']},{m['rtt_value']}" for m in request()["data"]["measurements"]))
    assert cli.main(["validate", str(csv)]) == 0
    assert '"total": 200' in capsys.readouterr().out
    assert cli.main(["analyze", str(csv), "--algorithm", "adtk", "--output", str(tmp_path / "out"), "--output-format", "csv", "--config", str(settings)]) == 0
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).columns == ["series_id", "starts", "ends", "congestion"]
    assert cli.main(["report", str(csv), "--algorithm", "adtk", "--output", str(tmp_path / "report")]) == 0
    page, report = (tmp_path / "report" / "index.html").read_text(), json.loads((tmp_path / "report" / "report.json").read_text())
    assert page.count("<svg") == 5 and "<polyline" in page and report["metadata"]["measurements"] == 200 and report["series"] == 1
    plots = {name: spark.read.parquet(str(tmp_path / "report" / "plots" / name)) for name in report["relations"]}
    assert plots["minima"].count() == 200 and plots["timeline"].where("mean is not null").count() == 200
    assert plots["timeline"].agg({"changes": "sum"}).first()[0] == plots["change_points"].count() == report["metadata"]["change_points"]
    assert cli.main(["visualize", str(csv), "--algorithm", "adtk", "--output", str(tmp_path / "plots")]) == 0
    assert spark.read.parquet(str(tmp_path / "plots" / "steps")).count() == 2 * report["metadata"]["inferences"]
    assert cli.main(["compare", str(csv), "--algorithms", "adtk", "torch", "--output", str(tmp_path / "compared")]) == 0
    rows = json.loads((tmp_path / "compared" / "comparison.json").read_text())
    assert [r["algorithm"] for r in rows] == ["adtk", "torch"] and all(r["n"] >= 1 for r in rows)


def test_timeline_slots(spark):
    from rillscope.sinks.report import confidence_cells, timeline

    minima = spark.createDataFrame([("a", float(e), float(v)) for e, v in ((0, 5), (9, 7), (50, 1), (100, 3))] + [("b", 5.0, 2.0)], "series_id string, epoch double, rtt_value double")
    inf = spark.createDataFrame([("a", 15.0, 35.0, True, 0.9), ("a", 35.0, 60.0, False, 0.0)], "series_id string, start_epoch double, end_epoch double, is_congested boolean, confidence double")
    cps = spark.createDataFrame([("a", 15.0), ("a", 18.0), ("b", 5.0)], "series_id string, epoch double")
    got = {(r.series_id, r.slot): (r.low, r.mean, r.high, r.congested, r.changes) for r in timeline(minima, inf, cps, 10).collect()}
    empty = (None, None, None, True, 0)
    assert got == {("a", 0): (5.0, 6.0, 7.0, False, 0), ("a", 1): (None, None, None, True, 2), ("a", 2): empty, ("a", 3): empty, ("a", 5): (1.0, 1.0, 1.0, False, 0), ("a", 9): (3.0, 3.0, 3.0, False, 0), ("b", 0): (2.0, 2.0, 2.0, False, 1)}
    assert sorted((r.y, r.n, r.congested) for r in confidence_cells(inf).collect()) == [(0, 1, 0), (18, 1, 1)]
