"""CSV, scamper JSON lines and time-series-database frames."""

from __future__ import annotations

from functools import reduce
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import RTT_ALIASES, valid
from .influx import read_influx

SCAMPER = "type string, src string, dst string, responses array<struct<rtt: double, tx: struct<sec: bigint, usec: bigint>>>"
INFLUX_ALIASES = ("_value", "rtt", "latency", "values")


def infer_format(spark: SparkSession, path: str) -> str:
    """csv, json or influx, by the suffix or else by the first line."""
    suffix = PurePosixPath(path).suffix.lower()
    known = {".csv": "csv", ".json": "json", ".influx": "influx", ".flux": "influx"}
    if suffix in known:
        return known[suffix]
    first = spark.read.text(path).limit(1).first()
    line = (first.value if first else "").strip()
    return "json" if line.startswith("{") else "csv" if "," in line else "influx"


def normalize(df: DataFrame, series_id: str | None = None, mode: str = "drop", aliases: tuple[str, ...] = RTT_ALIASES) -> DataFrame:
    """Samples from a frame with ``epoch`` and a value column.

    ``mode``: "drop" leaves invalid rows out, "strict" raises if there are any.
    ``series_id`` names a column that tells series apart; without it all rows
    are one series.
    """
    value = next((c for c in aliases if c in df.columns), None)
    if "epoch" not in df.columns or value is None:
        raise ValueError(f"an epoch column and one of {aliases} are needed, found {df.columns}")
    us = F.round(F.col("epoch").cast("double") * 1e6).cast("bigint")
    text = lambda c: (F.col(c) if c in df.columns else F.lit(None)).cast("string").alias(c)
    seq = F.col("seq").cast("bigint") if "seq" in df.columns else F.monotonically_increasing_id()
    series = F.col(series_id).cast("string") if series_id else F.lit("all")
    out = df.select(series.alias("series_id"), seq.alias("seq"), us.alias("epoch_us"), F.col("epoch").cast("double").alias("epoch"), F.col(value).cast("double").alias("rtt_value"), text("source"), text("destination"))
    good = valid() & F.col("epoch").isNotNull()
    if mode == "strict":
        bad = out.where(~F.coalesce(good, F.lit(False))).limit(1).count()
        if bad:
            raise ValueError("a round-trip time is outside its range, or a row has no epoch or value")
    return out.where(good)


def csv_schema(header: str) -> str:
    """Types of the columns that a header names: numbers for times and values, text for the rest."""
    names = [n.strip().strip('"') for n in header.split(",")]
    kinds = {"epoch": "double", "seq": "bigint"} | dict.fromkeys(RTT_ALIASES, "double")
    return ", ".join(f"`{n}` {kinds.get(n, 'string')}" for n in names)


def read_csv(spark: SparkSession, path: str, mode: str = "drop", per_file: bool = False) -> DataFrame:
    """Samples from CSV files with one header; ``per_file`` makes each file a series.

    Columns have the types of :func:`csv_schema`.  A value that is no number
    ends the reading in the mode "strict", and its row is left out in "drop".
    """
    first = spark.read.text(path).limit(1).first()
    if first is None:
        raise ValueError(f"no header in {path}")
    df = spark.read.schema(csv_schema(first.value)).option("header", True).option("mode", "FAILFAST" if mode == "strict" else "PERMISSIVE").csv(path)
    if per_file:
        df = df.withColumn("file", F.col("_metadata.file_path"))
    return normalize(df, "file" if per_file else None, mode)


def scamper_samples(lines: DataFrame) -> DataFrame:
    """One row per answered ping of JSON lines (column ``value``; others stay), other lines left out."""
    more = [c for c in lines.columns if c != "value"]
    rows = lines.select(F.from_json("value", SCAMPER).alias("r"), *more).where("r.type = 'ping'").select("r.src", "r.dst", F.explode("r.responses").alias("a"), *more)
    rows = rows.where("a.rtt is not null and a.tx.sec is not null and a.tx.usec is not null")
    us = F.col("a.tx.sec") * 1_000_000 + F.col("a.tx.usec")
    return rows.select(us.alias("epoch_us"), (us / 1e6).alias("epoch"), F.col("a.rtt").alias("rtt_value"), F.col("src").alias("source"), F.col("dst").alias("destination"), *more)


def read_scamper(spark: SparkSession, path: str, mode: str = "drop", series_id: str | None = None, per_file: bool = False) -> DataFrame:
    """Samples from scamper JSON lines; order is given by time, so no sort is stored.  ``per_file`` makes each file a series."""
    lines = spark.read.text(path)
    if per_file:
        lines, series_id = lines.select("value", F.col("_metadata.file_path").alias("file")), "file"
    return normalize(scamper_samples(lines), series_id, mode)


def concat_frames(frames: list[DataFrame], mode: str = "drop") -> DataFrame:
    """Samples from time-series-database tables with ``_time`` and a value column."""
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    df = df.withColumn("epoch", F.unix_micros(F.col("_time").cast("timestamp")) / 1e6)
    return normalize(df, None, mode, INFLUX_ALIASES)


def read_path(spark: SparkSession, path: str, kind: str | None = None, mode: str = "drop", per_file: bool = False) -> DataFrame:
    """Samples from a path (or pattern) of a known or inferred format; ``per_file`` makes each file a series."""
    kind = kind or infer_format(spark, path)
    if kind == "csv":
        return read_csv(spark, path, mode, per_file)
    if kind == "json":
        return read_scamper(spark, path, mode, per_file=per_file)
    if kind == "influx":
        return read_influx(spark, path, mode, "file" if per_file else None)
    raise ValueError(f"unknown format: {kind}")


def read_expected(spark: SparkSession, path: str) -> DataFrame:
    """Expected periods (starts, ends, congestion)."""
    return spark.read.schema("starts double, ends double, congestion double").option("header", True).csv(path)
