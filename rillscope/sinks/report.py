"""A report of one analysis: plot-ready relations as files, statistics, and a page with drawings.

All series go to the files.  The page shows the SHOWN series with most congested
time; what it draws is reduced to SLOTS slots of time per series in Spark first,
so the driver receives a bounded number of rows however long the series are.
Files are written through Hadoop's file system, so a path may be anywhere.
"""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import summary as plots

SLOTS, SHOWN, BINS = 400, 20, 20


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file at a path of any file system."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(text.encode())
    finally:
        out.close()


def timeline(minima: DataFrame, inf: DataFrame, cps: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(series_id, slot, epoch, low, mean, high, congested, changes): each series in ``slots`` equal slots of its time; slots without anything have no row."""
    ends = minima.groupBy("series_id").agg(F.min("epoch").alias("lo"), F.max("epoch").alias("hi"))
    width = F.greatest((F.col("hi") - F.col("lo")) / slots, F.lit(1e-6))
    slot = lambda e: F.least(F.floor((F.col(e) - F.col("lo")) / width), F.lit(slots - 1)).cast("int")
    a = minima.join(ends, "series_id").select("series_id", slot("epoch").alias("slot"), (F.col("lo") + slot("epoch") * width).alias("epoch"), F.col("rtt_value").alias("v"), F.lit(False).alias("congested"), F.lit(0).alias("change"))
    # A congested period stands in every slot that it reaches.
    b = inf.where("is_congested").join(ends, "series_id").select("series_id", "lo", width.alias("w"), F.explode(F.sequence(F.greatest(F.lit(0), slot("start_epoch")), F.greatest(F.lit(0), slot("end_epoch")))).alias("slot"))
    b = b.select("series_id", "slot", (F.col("lo") + F.col("slot") * F.col("w")).alias("epoch"), F.lit(None).cast("double").alias("v"), F.lit(True).alias("congested"), F.lit(0).alias("change"))
    c = cps.join(ends, "series_id").select("series_id", slot("epoch").alias("slot"), (F.col("lo") + slot("epoch") * width).alias("epoch"), F.lit(None).cast("double").alias("v"), F.lit(False).alias("congested"), F.lit(1).alias("change"))
    rows = a.unionByName(b).unionByName(c)
    return rows.groupBy("series_id", "slot").agg(F.min("epoch").alias("epoch"), F.min("v").alias("low"), F.avg("v").alias("mean"), F.max("v").alias("high"), F.bool_or("congested").alias("congested"), F.sum("change").alias("changes"))


def confidence_cells(inf: DataFrame, bins: int = BINS) -> DataFrame:
    """(x, y, n, congested): periods by the logarithm of their minutes and by confidence, in ``bins`` by ``bins`` cells."""
    minutes = (F.col("end_epoch") - F.col("start_epoch")) / 60
    x = F.least(F.floor(F.log10(F.greatest(minutes, F.lit(1.0))) / 5 * bins), F.lit(bins - 1)).cast("int")
    y = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("int")
    return inf.groupBy(x.alias("x"), y.alias("y")).agg(F.count("*").alias("n"), F.count_if("is_congested").alias("congested"))


def plot_relations(result) -> dict[str, DataFrame]:
    """All relations that the drawings, or others made elsewhere, take."""
    inf = result.inferences
    return {
        "steps": plots.step_series(inf),
        "points": plots.duration_points(inf),
        "hours": plots.hour_histogram(inf),
        "heatmap": plots.heatmap(inf),
        "durations": plots.histogram(inf, F.col("end_epoch") - F.col("start_epoch")),
        "confidences": plots.histogram(inf, F.col("confidence")),
        "cells": confidence_cells(inf),
        "timeline": timeline(result.minima, inf, result.change_points),
        "minima": result.minima,
        "change_points": result.change_points,
    }


def _bars(title: str, values: dict[int, list[float]], colors: tuple[str, ...] = ("#7a9", "#c44")) -> str:
    """Stacked bars by number."""
    top = max((sum(v) for v in values.values()), default=0) or 1
    wide = 600 / max(1, max(values, default=0) + 1)
    out = ""
    for k, parts in sorted(values.items()):
        base = 120.0
        for v, color in zip(parts, colors, strict=False):
            tall = 120 * v / top
            base -= tall
            out += f'<rect x="{k * wide:.1f}" y="{base:.1f}" width="{wide * 0.9:.1f}" height="{tall:.1f}" fill="{color}"><title>{k}: {v:g}</title></rect>'
    return f'<h3>{html.escape(title)}</h3><svg viewBox="0 0 600 120" width="600">{out}</svg>'


def _line(name: str, rows: list) -> str:
    """Range and mean of a series, congested slots behind it, change points as ticks."""
    top = max((r.high for r in rows if r.high is not None), default=1.0) or 1.0
    y = lambda v: 100 * (1 - v / top)
    behind = "".join(f'<rect x="{r.slot}" y="0" width="1" height="100" fill="#fbb"/>' for r in rows if r.congested)
    spread = "".join(f'<rect x="{r.slot}" y="{y(r.high):.2f}" width="1" height="{max(0.2, y(r.low) - y(r.high)):.2f}" fill="#9bd"/>' for r in rows if r.high is not None)
    mean = " ".join(f"{r.slot + 0.5},{y(r.mean):.2f}" for r in rows if r.mean is not None)
    ticks = "".join(f'<path d="M{r.slot + 0.5} 100v6" stroke="#333" stroke-width="0.6"/>' for r in rows if r.changes)
    return f'<h3>{html.escape(name)} <small>(up to {top:.3g} ms)</small></h3><svg viewBox="0 0 {SLOTS} 106" width="100%" height="160" preserveAspectRatio="none">{behind}{spread}<polyline points="{mean}" fill="none" stroke="#137" stroke-width="0.4"/>{ticks}</svg>'


def _table(rows: list[dict]) -> str:
    head = "".join(f"<th>{html.escape(k)}</th>" for k in (rows[0] if rows else {}))
    body = "".join("<tr>" + "".join(f"<td>{html.escape(f'{v:.6g}' if isinstance(v, float) else str(v))}</td>" for v in r.values()) + "</tr>" for r in rows)
    return f"<table border=1 cellspacing=0 cellpadding=4><tr>{head}</tr>{body}</table>"


def write_report(spark: SparkSession, result, path: str, title: str = "Congestion") -> dict:
    """Write relations (``plots/``), statistics of all series (``statistics/``), ``report.json`` and ``index.html``; gives what report.json holds."""
    path = path.rstrip("/")
    relations = plot_relations(result)
    for name, df in relations.items():
        df.write.mode("overwrite").parquet(f"{path}/plots/{name}")
    made = {name: spark.read.schema(df.schema).parquet(f"{path}/plots/{name}") for name, df in relations.items()}
    stats = plots.dashboard_statistics(result.inferences, made["change_points"]).join(plots.report_metadata(result.samples, made["minima"], result.inferences).drop("hours"), "series_id", "left")
    stats.write.mode("overwrite").parquet(f"{path}/statistics")
    stats = spark.read.parquet(f"{path}/statistics")
    top = stats.orderBy(F.col("sum_duration").desc_nulls_last(), "series_id").limit(SHOWN)
    shown = [r.asDict() for r in top.collect()]
    drawn: dict[str, list] = {s["series_id"]: [] for s in shown}
    for r in made["timeline"].join(F.broadcast(top.select("series_id")), "series_id").orderBy("series_id", "slot").collect():  # SHOWN times SLOTS rows at most
        drawn[r.series_id].append(r)
    few = lambda name: made[name].collect()  # noqa: E731  at most BINS squared rows
    hours = {r.hour: [r.normal, r.congested] for r in few("hours")}
    cells = "".join(f'<rect x="{r.x * 20}" y="{(BINS - 1 - r.y) * 10}" width="19" height="9" fill="{"#c44" if r.congested * 2 > r.n else "#7a9"}" opacity="{min(1.0, 0.25 + r.n / 20):.2f}"><title>{r.n}</title></rect>' for r in few("cells"))
    report = {"title": title, "metadata": result.metadata.first().asDict(), "series": stats.count(), "shown": shown, "relations": {n: f"plots/{n}" for n in relations}}
    page = "".join(_line(n, rows) for n, rows in drawn.items()) + _bars("Periods by hour of day", hours) + _bars("Durations", {r.bin: [r.n] for r in few("durations")}) + _bars("Confidences", {r.bin: [r.n] for r in few("confidences")})
    page += f'<h3>Duration (log) and confidence</h3><svg viewBox="0 0 {BINS * 20} {BINS * 10}" width="600">{cells}</svg>'
    write_text(spark, f"{path}/report.json", json.dumps(report, indent=2, default=str))
    write_text(spark, f"{path}/index.html", f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>{_table([report['metadata']])}<h2>Series</h2>{_table(shown)}{page}")
    return report


def write_comparison(spark: SparkSession, change_points: DataFrame, path: str) -> list[dict]:
    """Number, mean confidence and its deviation of each detector's change points: by series as Parquet, over all as ``comparison.json``."""
    path = path.rstrip("/")
    by = change_points.withColumn("algorithm", F.col("detector"))
    by.groupBy("series_id", "detector").agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"), F.coalesce(F.stddev_samp("confidence"), F.lit(0.0)).alias("std_confidence")).write.mode("overwrite").parquet(f"{path}/comparison")
    order = Window.partitionBy("series_id", "detector").orderBy("epoch")
    change_points.withColumn("place", F.row_number().over(order) - 1).write.mode("overwrite").parquet(f"{path}/change_points")
    rows = [r.asDict() for r in plots.comparison(by).orderBy("algorithm").collect()]  # one per detector
    write_text(spark, f"{path}/comparison.json", json.dumps(rows, indent=2))
    return rows
