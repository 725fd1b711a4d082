"""Projections and files of inferences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.summary import export_summary


def narrow(inf: DataFrame) -> DataFrame:
    """starts, ends, congestion (1.0 or 0.0)."""
    return inf.select("series_id", F.col("start_epoch").alias("starts"), F.col("end_epoch").alias("ends"), F.col("is_congested").cast("double").alias("congestion"))


def wide(inf: DataFrame) -> DataFrame:
    """Narrow with confidence and both kinds of evidence, false where one is missing."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    return inf.select("series_id", F.col("start_epoch").alias("starts"), F.col("end_epoch").alias("ends"), F.col("is_congested").cast("double").alias("congestion"), "confidence", flag("latency_jump.has_jump").alias("has_latency_jump"), flag("jitter_analysis.has_significant_jitter").alias("has_jitter_change"))


def json_lines(inf: DataFrame) -> DataFrame:
    """One JSON object per period, with ISO times."""
    iso = lambda c: F.date_format(F.timestamp_micros(F.round(F.col(c) * 1e6).cast("bigint")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    return inf.withColumn("start_timestamp", iso("start_epoch")).withColumn("end_timestamp", iso("end_epoch")).select(F.to_json(F.struct("*")).alias("value"))


def nested_json(inf: DataFrame, metadata: DataFrame) -> DataFrame:
    """One JSON object per series: its periods in order, and the metadata."""
    row = F.struct("start_epoch", *(c for c in inf.columns if c not in ("series_id", "start_epoch")))
    per = inf.groupBy("series_id").agg(F.sort_array(F.collect_list(row)).alias("inferences")).withColumn("k", F.lit(1))
    return per.join(metadata.select(F.lit(1).alias("k"), F.struct("*").alias("metadata")), "k").select(F.to_json(F.struct("series_id", "inferences", "metadata")).alias("value"))


def summary_json(inf: DataFrame) -> DataFrame:
    """One JSON object of summary figures per series."""
    return export_summary(inf).select(F.to_json(F.struct("*")).alias("value"))


def enhanced(inf: DataFrame) -> DataFrame:
    """Wide with the figures behind both kinds of evidence."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    return inf.select("series_id", F.col("start_epoch").alias("starts"), F.col("end_epoch").alias("ends"), (F.col("end_epoch") - F.col("start_epoch")).alias("duration"), F.col("is_congested").cast("double").alias("congestion"), "confidence", flag("latency_jump.has_jump").alias("has_latency_jump"), F.col("latency_jump.magnitude").alias("jump_magnitude"), flag("jitter_analysis.has_significant_jitter").alias("has_jitter_change"), F.col("jitter_analysis.jitter_metric").alias("jitter_metric"), F.col("jitter_analysis.method").alias("jitter_method"))


def columnar(inf: DataFrame) -> DataFrame:
    """One row per series: its periods in order as parallel arrays."""
    row = F.struct("start_epoch", "end_epoch", "is_congested", "confidence")
    per = inf.groupBy("series_id").agg(F.sort_array(F.collect_list(row)).alias("p"))
    return per.select("series_id", F.col("p.start_epoch").alias("starts"), F.col("p.end_epoch").alias("ends"), F.transform("p.is_congested", lambda c: c.cast("int")).alias("congestion"), F.col("p.confidence").alias("confidence"))


def _iso(epoch: str):
    return F.date_format(F.timestamp_micros(F.round(F.col(epoch) * 1e6).cast("bigint")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def _in_order(inf: DataFrame, *columns) -> DataFrame:
    """(series_id, p): structs of ``columns`` of a series' periods in order."""
    row = F.struct("start_epoch", "end_epoch", F.struct(*columns).alias("r"))
    return inf.groupBy("series_id").agg(F.sort_array(F.collect_list(row)).alias("sorted")).select("series_id", F.col("sorted.r").alias("p"), "sorted")


def minimal_json(inf: DataFrame) -> DataFrame:
    """One object per series: bounds, state and confidence of its periods, and their counts."""
    per = _in_order(inf, F.col("start_epoch").alias("start"), F.col("end_epoch").alias("end"), F.col("is_congested").alias("congested"), F.round("confidence", 2).alias("confidence"))
    bad = F.filter("p", lambda r: r["congested"])
    spent = F.aggregate(bad, F.lit(0.0), lambda a, r: a + (r["end"] - r["start"]))
    total = F.struct(F.size("p").alias("total"), F.size(bad).alias("congested"), spent.alias("duration"))
    return per.select(F.to_json(F.struct("series_id", F.col("p").alias("congestion_periods"), total.alias("summary"))).alias("value"))


def detailed_json(inf: DataFrame, metadata: DataFrame) -> DataFrame:
    """One object per series: all that is known of its periods, by kind, and the metadata."""
    time = F.struct(_iso("start_epoch").alias("start"), _iso("end_epoch").alias("end"), ((F.col("end_epoch") - F.col("start_epoch")) / 60).alias("duration_minutes"))
    state = F.struct("is_congested", "confidence", F.col("confidence").alias("algorithm_confidence"))
    jump = F.struct(F.col("latency_jump.has_jump").alias("has_jump"), F.col("latency_jump.magnitude").alias("magnitude_ms"), F.col("latency_jump.threshold").alias("threshold_ms"))
    j = lambda c, name: F.col(f"jitter_analysis.{c}").alias(name)
    jit = F.struct(j("method", "method"), j("has_significant_jitter", "has_significant_change"), j("jitter_metric", "metric_value"), j("threshold", "threshold"), j("p_value", "p_value"))
    per = _in_order(inf, time.alias("time_period"), state.alias("congestion_inference"), jump.alias("latency_analysis"), jit.alias("jitter_analysis")).withColumn("k", F.lit(1))
    return per.join(metadata.select(F.lit(1).alias("k"), F.struct("*").alias("metadata")), "k").select(F.to_json(F.struct("series_id", F.col("p").alias("analysis_results"), "metadata")).alias("value"))


def time_series_json(inf: DataFrame) -> DataFrame:
    """One object per series: parallel arrays to plot, 0 where a kind of evidence is missing."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    per = _in_order(inf, _iso("start_epoch").alias("timestamps"), F.col("is_congested").alias("congestion_status"), F.col("confidence").alias("confidence_scores"), zero("latency_jump.magnitude").alias("latency_jumps"), zero("jitter_analysis.jitter_metric").alias("jitter_metrics"))
    names = ("timestamps", "congestion_status", "confidence_scores", "latency_jumps", "jitter_metrics")
    return per.select(F.to_json(F.struct("series_id", *(F.col(f"p.{n}").alias(n) for n in names))).alias("value"))


def with_metadata(inf: DataFrame, metadata: DataFrame) -> DataFrame:
    """Narrow columns, the figures behind both kinds of evidence, and the metadata on every row."""
    figures = {"latency_jump_magnitude": "latency_jump.magnitude", "latency_jump_threshold": "latency_jump.threshold", "jitter_method": "jitter_analysis.method", "jitter_metric": "jitter_analysis.jitter_metric", "jitter_threshold": "jitter_analysis.threshold"}
    base = [F.col("start_epoch").alias("starts"), F.col("end_epoch").alias("ends"), F.col("is_congested").cast("double").alias("congestion")]
    rows = inf.select("series_id", *base, *(F.col(c).alias(n) for n, c in figures.items()), "confidence", F.lit(1).alias("k"))
    about = metadata.select(F.lit(1).alias("k"), F.col("measurements").alias("total_measurements"), F.col("algorithm").alias("algorithm_used"))
    return rows.join(about, "k").drop("k")


def xml_lines(inf: DataFrame) -> DataFrame:
    """One XML element per period."""
    return enhanced(inf).select(F.to_xml(F.struct("*"), {"rowTag": "period", "indent": ""}).alias("value"))


def yaml_lines(inf: DataFrame) -> DataFrame:
    """One item of a YAML list per period; its values are JSON, which YAML includes."""
    return enhanced(inf).select(F.concat(F.lit("- "), F.to_json(F.struct("*"))).alias("value"))


def save(inf: DataFrame, path: str, kind: str = "json", full: bool = False, mode: str = "error", metadata: DataFrame | None = None) -> None:
    """Write JSON (nested with ``metadata``, one object per series; else lines), CSV, Parquet, XML or YAML; ``full`` takes the wide columns.

    Further kinds: minimal, detailed and time-series (one JSON object per
    series), and, with ``metadata`` and ``full``, Parquet with it on every row.
    """
    out = wide(inf) if full else narrow(inf)
    if kind == "json":
        (json_lines(inf) if metadata is None else nested_json(inf, metadata)).write.mode(mode).text(path)
    elif kind in ("minimal", "time-series"):
        (minimal_json if kind == "minimal" else time_series_json)(inf).write.mode(mode).text(path)
    elif kind == "detailed":
        if metadata is None:
            raise ValueError("the detailed output needs metadata")
        detailed_json(inf, metadata).write.mode(mode).text(path)
    elif kind in ("xml", "yaml"):
        (xml_lines if kind == "xml" else yaml_lines)(inf).write.mode(mode).text(path)
    elif kind == "csv":
        out.write.mode(mode).option("header", True).csv(path)
    elif kind == "parquet":
        (with_metadata(inf, metadata) if full and metadata is not None else out).write.mode(mode).parquet(path)
    else:
        raise ValueError(f"unknown output format: {kind}")
