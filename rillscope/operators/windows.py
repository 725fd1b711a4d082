"""Minima of time bins, jitter and its moving statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import exact_quantiles
from .ranges import STRETCH_US, order_of, placed, range_window, with_halo

DAY_US = 86_400_000_000


def bin_start(minutes: int, first: Column | None = None) -> Column:
    """Start of the bin that holds ``epoch_us``; ``first`` anchors bins at the first sample's midnight."""
    width = minutes * 60_000_000
    if 1440 % minutes == 0:
        return F.expr(f"epoch_us - pmod(epoch_us, {width})")
    day = first - F.pmod(first, F.lit(DAY_US))
    return F.col("epoch_us") - F.pmod(F.col("epoch_us") - day, F.lit(width))


def min_intervals(samples: DataFrame, minutes: int = 15, least: int = 0) -> DataFrame:
    """(series_id, bin_us, epoch_us, epoch, rtt_value): earliest sample and least value of each bin.

    One hash aggregation with partial sums before the shuffle.  Widths that do
    not divide a day need the series' first sample, a second small aggregation.
    """
    if 1440 % minutes:
        first = samples.groupBy("series_id").agg(F.min("epoch_us").alias("first_us"))
        samples = samples.join(first, "series_id")
        keyed = samples.withColumn("bin_us", bin_start(minutes, F.col("first_us")))
    else:
        keyed = samples.withColumn("bin_us", bin_start(minutes))
    out = keyed.groupBy("series_id", "bin_us").agg(F.min("epoch_us").alias("epoch_us"), F.min("rtt_value").alias("rtt_value"), F.count("*").alias("n"))
    if least:
        out = out.where(F.col("n") >= least)
    return out.select("series_id", "bin_us", "epoch_us", (F.col("epoch_us") / 1e6).alias("epoch"), "rtt_value")


def jitter(series: DataFrame) -> DataFrame:
    """(series_id, epoch_us, epoch, jitter) with the time of the later of two neighbours."""
    keep = ["series_id", *order_of(series), "epoch"]
    previous = with_previous(series, "rtt_value", "previous", bucket=STRETCH_US)
    return previous.withColumn("jitter", F.col("rtt_value") - F.col("previous")).where("jitter is not null").select(*keep, "jitter")


def with_previous(samples: DataFrame, column: str, name: str, order: str = "epoch_us", bucket: float = DAY_US, ahead: bool = False) -> DataFrame:
    """With the ``column`` of the sample before (by ``order`` and seq), without sorting a whole series in one task.

    Series are cut into ranges of ``order``; the last sample of the range before
    (a small aggregate) stands in for the neighbour of a range's first sample.
    ``ahead`` takes the sample after instead.
    """
    keyed = samples.withColumn("bucket", F.floor(F.col(order) / bucket))
    by = [order, "seq"] if order != "seq" and "seq" in samples.columns else [order]
    edge, beside = (F.min_by, F.lead) if ahead else (F.max_by, F.lag)
    edges = keyed.groupBy("series_id", "bucket").agg(edge(F.struct(F.col(column).alias("v")), F.struct(*by)).alias("edge"))
    over = edges.select("series_id", "bucket", beside("edge").over(Window.partitionBy("series_id").orderBy("bucket")).alias("over"))
    w = Window.partitionBy("series_id", "bucket").orderBy(*by)
    out = keyed.withColumn(name, beside(F.struct(F.col(column).alias("v"))).over(w)).join(over, ["series_id", "bucket"])
    return out.withColumn(name, F.coalesce(name, "over")["v"]).drop("bucket", "over")


def raw_jitter(samples: DataFrame, bucket_us: int = DAY_US) -> DataFrame:
    """Jitter of raw samples, in ranges of time."""
    out = with_previous(samples, "rtt_value", "previous", bucket=bucket_us).withColumn("jitter", F.col("rtt_value") - F.col("previous"))
    return out.where("jitter is not null").select("series_id", "epoch_us", "seq", "epoch", "jitter")


def _full(value: Column, w, size: int) -> Column:
    return F.when(F.count("*").over(w) == size, value)


def _iqr(w) -> Column:
    return F.percentile("jitter", F.lit(0.75)).over(w) - F.percentile("jitter", F.lit(0.25)).over(w)


def moving_iqr(jit: DataFrame, k: int = 4) -> DataFrame:
    """Interquartile range over the 2k + 1 rows around each row that has them all."""
    w = range_window().rowsBetween(-k, k)
    rows = with_halo(placed(jit), k, k).withColumn("iqr", _full(_iqr(w), w, 2 * k + 1))
    return rows.where("own and iqr is not null").select(*jit.columns, "iqr")


def moving_average(df: DataFrame, column: str, m: int = 6) -> DataFrame:
    """Mean of ``m`` rows, m/2 before to m/2 - 1 after, where all are there."""
    w = range_window().rowsBetween(-(m // 2), m // 2 - 1)
    rows = with_halo(placed(df), m // 2, max(0, m // 2 - 1)).withColumn("average", _full(F.avg(column).over(w), w, m))
    return rows.where("own and average is not null").select(*df.columns, "average")


def jitter_dispersion(series: DataFrame, k: int = 4, m: int = 6) -> DataFrame:
    """(series_id, epoch_us, epoch, dispersion): averaged interquartile range of the jitter.

    The three windows share one cut into ranges, whose halo is as wide as all of
    them together.
    """
    w = range_window()
    near, mean = w.rowsBetween(-k, k), w.rowsBetween(-(m // 2), m // 2 - 1)
    rows = with_halo(placed(series), 1 + k + m // 2, k + m // 2 - 1)
    rows = rows.withColumn("jitter", F.col("rtt_value") - F.lag("rtt_value").over(w)).where("jitter is not null")
    rows = rows.withColumn("iqr", _full(_iqr(near), near, 2 * k + 1)).where("iqr is not null")
    rows = rows.withColumn("dispersion", _full(F.avg("iqr").over(mean), mean, m))
    return rows.where("own and dispersion is not null").select("series_id", "epoch_us", "epoch", "dispersion")


def time_gaps(samples: DataFrame) -> DataFrame:
    """Seconds since the sample before."""
    gap = (F.col("epoch_us") - F.col("previous_us")) / 1e6
    return with_previous(samples, "epoch_us", "previous_us").withColumn("gap", gap).where("gap is not null").select("series_id", "seq", "epoch", "gap")


SEQ_RANGE = 1 << 20


def validation_metrics(samples: DataFrame) -> DataFrame:
    """One row per series: counts, order, duplicates, outliers beyond three deviations, intervals, moments and range."""
    t = with_previous(with_previous(samples, "epoch_us", "read_before", "seq", SEQ_RANGE), "epoch_us", "previous_us")
    t = t.withColumn("ordered", F.coalesce(F.col("read_before") <= F.col("epoch_us"), F.lit(True))).withColumn("gap", (F.col("epoch_us") - F.col("previous_us")) / 1e6)
    moments = samples.groupBy("series_id").agg(F.avg("rtt_value").alias("mu"), F.stddev_pop("rtt_value").alias("sd"))
    t = t.join(moments, "series_id").withColumn("outlier", (F.abs(F.col("rtt_value") - F.col("mu")) > 3 * F.col("sd")) & (F.col("sd") > 0))
    medians = exact_quantiles(samples, "rtt_value", [0.5], ["series_id"]).select("series_id", F.col("value").alias("median_rtt"))
    metrics = t.groupBy("series_id").agg(
        F.count("*").alias("total"),
        F.bool_and("ordered").alias("time_ordered"),
        # A time is new where the sample before has another one.
        F.count_if(F.coalesce(F.col("gap") != 0, F.lit(True))).alias("unique_timestamps"),
        (F.count_if(F.coalesce(F.col("gap") != 0, F.lit(True))) < F.count("*")).alias("has_duplicates"),
        F.count_if("outlier").alias("outliers"),
        F.avg("gap").alias("average_interval"),
        F.max("gap").alias("max_gap"),
        F.min("rtt_value").alias("min_rtt"),
        F.max("rtt_value").alias("max_rtt"),
        F.avg("rtt_value").alias("mean_rtt"),
        F.stddev_pop("rtt_value").alias("std_rtt"),
        ((F.max("epoch_us") - F.min("epoch_us")) / 1e6).alias("duration"),
    )
    return metrics.join(medians, "series_id", "left")


def without_outliers(samples: DataFrame, z: float = 3.0) -> DataFrame:
    """Samples within ``z`` population deviations of their series' mean."""
    moments = samples.groupBy("series_id").agg(F.avg("rtt_value").alias("mu"), F.stddev_pop("rtt_value").alias("sd"))
    return samples.join(moments, "series_id").where(F.abs(F.col("rtt_value") - F.col("mu")) <= z * F.col("sd")).drop("mu", "sd")


def indexed(series: DataFrame) -> DataFrame:
    """With a dense index ``i`` from 0 and the series' length ``n``."""
    return placed(series)
