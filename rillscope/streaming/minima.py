"""Minima of tumbling windows over a stream of samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import state_store


def stream_min_intervals(samples: DataFrame, minutes: int = 15, late: str = "30 minutes") -> DataFrame:
    """Minima per series and window of a streaming frame with ``ts``; rows later than ``late`` are left out."""
    w = samples.withWatermark("ts", late).groupBy("series_id", F.window("ts", f"{minutes} minutes").alias("w"))
    return w.agg(F.min(F.unix_micros("ts")).alias("epoch_us"), F.min("rtt_value").alias("rtt_value")).select("series_id", F.unix_micros("w.start").alias("bin_us"), "epoch_us", (F.col("epoch_us") / 1e6).alias("epoch"), "rtt_value")


def stream_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is available now into Parquet files and stop."""
    with state_store(stream.sparkSession):
        q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    q.awaitTermination()
