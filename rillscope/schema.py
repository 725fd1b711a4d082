"""Column layouts of the relations, and the view of ``events`` as samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Valid round-trip times, in milliseconds: above the first, up to the second.
RTT_RANGE = (0.0, 10_000.0)
#: Names that the value column may have, the first present is taken.
RTT_ALIASES = ("values", "rtt_value", "rtt", "latency")

SAMPLE = "series_id string, seq bigint, epoch_us bigint, epoch double, rtt_value double, source string, destination string"
CHANGE_POINT = "series_id string, cp_idx int, epoch double, confidence double, algorithm string"


def valid(value: str = "rtt_value"):
    """The range predicate."""
    return (F.col(value) > RTT_RANGE[0]) & (F.col(value) <= RTT_RANGE[1])


def events_as_samples(spark: SparkSession, sf_dir: str, series: str = "event_type") -> DataFrame:
    """The ``events`` table as samples: one series for each value of ``series``."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select(F.col(series).cast("string").alias("series_id"), F.col("event_id").alias("seq"), us.alias("epoch_us"), (us / 1e6).alias("epoch"), F.col("value").alias("rtt_value")).where(valid())
