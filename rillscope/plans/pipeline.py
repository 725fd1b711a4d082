"""From samples to congestion periods, as lazy relations."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import ChangePoints, Config
from ..operators import detectors, inference, periods, sequential, windows
from ..sources import normalize, read_path
from ..storage import shared_path

#: Detector by name: (minima, settings) -> (series_id, epoch, confidence, algorithm).
DETECTORS: dict[str, Callable[[DataFrame, ChangePoints], DataFrame]] = {
    "ruptures": lambda m, c: sequential.detect_pelt(m, c.ruptures_model, c.ruptures_penalty, c.threshold, c.min_time_elapsed),
    "bcp": lambda m, c: sequential.detect_bcp(m, c.threshold),
    "torch": lambda m, c: sequential.detect_welch(m, c.threshold, c.min_time_elapsed, c.max_change_points),
    "rbeast": lambda m, c: detectors.detect_bayes_windows(m, c.threshold, c.min_time_elapsed),
    "adtk": lambda m, c: detectors.detect_level_shifts(m, c.threshold, c.min_time_elapsed),
}


def register_detector(name: str, find: Callable[[DataFrame, ChangePoints], DataFrame]) -> None:
    """Add a detector under a new name."""
    DETECTORS[name] = find


def detect(minima: DataFrame, settings: ChangePoints, name: str | None = None) -> DataFrame:
    """Filtered change points (series_id, cp_idx, epoch, confidence, algorithm)."""
    found = DETECTORS[name or settings.algorithm](minima, settings)
    kept = detectors.filter_change_points(found, settings.min_time_elapsed, settings.max_change_points)
    idx = F.row_number().over(Window.partitionBy("series_id").orderBy("epoch")) - 1
    return kept.select("series_id", idx.alias("cp_idx"), "epoch", "confidence", "algorithm")


@dataclass
class Result:
    """The relations of one analysis.

    Minima and change points are written once to the shared folder, as all that
    follows reads them several times; the rest is lazy.
    """

    samples: DataFrame
    minima: DataFrame
    change_points: DataFrame
    jumps: DataFrame
    jitter: DataFrame
    inferences: DataFrame
    metadata: DataFrame


class Pipeline:
    """The analysis with its settings."""

    def __init__(self, spark: SparkSession, config: Config | None = None):
        self.spark, self.config = spark, config or Config()

    def run_path(self, path: str, kind: str | None = None, mode: str = "drop", per_file: bool = False) -> Result:
        return self.run(read_path(self.spark, path, kind, mode, per_file))

    def run_frame(self, df: DataFrame, series_id: str | None = None, mode: str = "drop") -> Result:
        return self.run(normalize(df, series_id, mode))

    def run(self, samples: DataFrame) -> Result:
        c = self.config
        if c.data_processing.outlier_detection:
            samples = windows.without_outliers(samples, c.data_processing.outlier_threshold)
        minima = windows.min_intervals(samples, c.data_processing.minimum_interval_minutes, c.data_processing.min_samples_per_interval)
        minima = self._kept(minima, "minima")
        cps = self._kept(detect(minima, c.change_point_detection), "change-points")
        spans = periods.periods_from_change_points(cps)
        jumps = periods.latency_jumps(minima, spans, c.latency_jump.threshold)
        j = c.jitter_analysis
        if j.method == "jitter_dispersion":
            jit = periods.dispersion_periods(windows.jitter_dispersion(minima, j.moving_iqr_order, j.moving_average_order), spans, j.threshold)
        else:
            jit = periods.ks_periods(windows.raw_jitter(samples), spans, j.significance_level)
        inf = inference.as_inferences(inference.congestion(inference.evidence(jumps, jit)))
        return Result(samples, minima, cps, jumps, jit, inf, self._metadata(samples, minima, cps, jumps, jit, inf))

    def _kept(self, df: DataFrame, tag: str) -> DataFrame:
        path = shared_path(self.spark, f"{tag}-{uuid.uuid4().hex}")
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _metadata(self, *frames: DataFrame) -> DataFrame:
        """One row of counts and settings, also where a relation is empty."""
        names = ("measurements", "intervals", "change_points", "latency_jumps", "jitter_analyses", "inferences")
        parts = [f.select(*(F.lit(1 if n == m else 0).alias(m) for m in names), (F.col("is_congested").cast("int") if n == "inferences" else F.lit(0)).alias("congested")) for n, f in zip(names, frames, strict=True)]
        total = reduce(DataFrame.unionByName, parts)
        c = self.config
        return total.agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in (*names, "congested"))).select("*", F.lit(c.change_point_detection.algorithm).alias("algorithm"), F.lit(c.jitter_analysis.method).alias("method"), F.lit(c.change_point_detection.threshold).alias("threshold"), F.when(F.col("intervals") < 2, "fewer than two intervals").alias("error"))


def compare(minima: DataFrame, settings: ChangePoints, names: list[str]) -> DataFrame:
    """Change points of several detectors in one relation, told apart by ``detector``."""
    return reduce(DataFrame.unionByName, [detect(minima, settings, n).withColumn("detector", F.lit(n)) for n in names])
