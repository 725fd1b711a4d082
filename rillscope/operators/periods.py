"""Periods between change points and what is measured in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ks import ks_p_value
from .quantiles import level

BUCKET_S = 86_400


def periods_from_change_points(cps: DataFrame) -> DataFrame:
    """(series_id, cp_idx, prev_epoch, start_epoch, end_epoch) of all change points that have both neighbours."""
    w = Window.partitionBy("series_id").orderBy("epoch")
    out = cps.select("series_id", (F.row_number().over(w) - 1).alias("cp_idx"), F.lag("epoch").over(w).alias("prev_epoch"), F.col("epoch").alias("start_epoch"), F.lead("epoch").over(w).alias("end_epoch"))
    return out.where("prev_epoch is not null and end_epoch is not null")


def _bounds(periods: DataFrame) -> DataFrame:
    """(series_id, epoch, ends_here, starts_here, before): each bound of the periods with the period that ends there, the one that starts there, and the one that it is the bound before."""
    period = F.struct("cp_idx", "start_epoch", "end_epoch")
    at = lambda c, name: periods.select("series_id", F.col(c).alias("epoch"), period.alias("period"), F.lit(name).alias("kind"))
    rows = at("end_epoch", "ends").unionByName(at("start_epoch", "starts")).unionByName(at("prev_epoch", "before"))
    pick = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("period")))
    return rows.groupBy("series_id", "epoch").agg(pick("ends").alias("ends_here"), pick("starts").alias("starts_here"), pick("before").alias("before"))


def in_periods(values: DataFrame, periods: DataFrame, bucket_s: int = BUCKET_S) -> DataFrame:
    """Rows of ``values`` with each period that they lie in or directly before; ``current`` tells which.

    The current part is closed at both ends, the part before half open.  Periods
    follow each other, as :func:`periods_from_change_points` makes them (some may
    be missing), so the last bound at or before a row says all: values and
    bounds are put in time order within buckets of time, and the last bound of
    the buckets before is carried over.  Nothing grows with a period's length,
    and no bucket holds more than its own rows.
    """
    kept = [c for c in values.columns if c != "series_id"]
    bounds = _bounds(periods)
    mark = F.struct("epoch", "ends_here", "starts_here", "before")
    cut = bounds.select("series_id", "epoch", mark.alias("bound"), F.lit(None).cast(values.select(F.struct(*kept)).schema[0].dataType).alias("value"))
    rows = values.select("series_id", "epoch", F.lit(None).cast(cut.schema["bound"].dataType).alias("bound"), F.struct(*kept).alias("value")).unionByName(cut)
    rows = rows.withColumn("bucket", F.floor(F.col("epoch") / bucket_s))
    # A bound stands before the values of its own time.
    upto = Window.partitionBy("series_id", "bucket").orderBy("epoch", F.col("value").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lasts = rows.groupBy("series_id", "bucket").agg(F.max_by("bound", F.when(F.col("bound").isNotNull(), F.col("epoch"))).alias("carried"))
    earlier = Window.partitionBy("series_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    lasts = lasts.select("series_id", "bucket", F.last("carried", ignorenulls=True).over(earlier).alias("carried"))
    found = rows.withColumn("bound", F.last("bound", ignorenulls=True).over(upto)).where("value is not null").join(lasts, ["series_id", "bucket"])
    found = found.select("series_id", "value", F.coalesce("bound", "carried").alias("b")).where("b is not null")
    role = lambda c, current: F.struct(F.col(f"b.{c}").alias("period"), F.lit(current).alias("current"))
    on_bound = F.when(F.col("value.epoch") == F.col("b.epoch"), role("ends_here", True))
    roles = F.filter(F.array(role("starts_here", True), role("before", False), on_bound), lambda r: r["period"].isNotNull())
    return found.select("series_id", "value.*", F.explode(roles).alias("r")).select("series_id", *kept, "r.period.*", "r.current")


KEYS = ["series_id", "cp_idx", "start_epoch", "end_epoch"]


def segment_stats(values: DataFrame, column: str, periods: DataFrame) -> DataFrame:
    """Mean and count in each period and before it, and the deviation before it."""
    now, before = F.when(F.col("current"), F.col(column)), F.when(~F.col("current"), F.col(column))
    return in_periods(values, periods).groupBy(*KEYS).agg(F.avg(now).alias("mean_now"), F.avg(before).alias("mean_before"), F.count(now).alias("n_now"), F.count(before).alias("n_before"), F.stddev_pop(before).alias("std_before"))


def latency_jumps(min_rtt: DataFrame, periods: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Rise of the mean over the period before; a jump if above the threshold."""
    s = segment_stats(min_rtt, "rtt_value", periods).where("n_now >= 1 and n_before >= 1")
    return s.select(*KEYS, (F.col("mean_now") - F.col("mean_before")).alias("magnitude")).withColumn("has_jump", F.col("magnitude") > threshold).withColumn("threshold", F.lit(threshold))


def latency_jumps_detailed(min_rtt: DataFrame, periods: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Jumps judged against the variation of the period before as well."""
    s = segment_stats(min_rtt, "rtt_value", periods).where("n_now >= 1 and n_before >= 1").withColumn("magnitude", F.col("mean_now") - F.col("mean_before"))
    own = F.lit(threshold) * (1 + F.col("std_before") / F.col("mean_before"))
    return s.select(*KEYS, "magnitude", ((F.col("magnitude") > own) & (F.col("magnitude") / (F.col("std_before") + 1e-6) > 1)).alias("has_jump"), F.lit(threshold).alias("threshold"))


def dispersion_periods(dispersion: DataFrame, periods: DataFrame, threshold: float = 0.25) -> DataFrame:
    """Rise of the mean jitter dispersion over the period before."""
    s = segment_stats(dispersion, "dispersion", periods).where("n_now >= 2 and n_before >= 1")
    return s.select(*KEYS, (F.col("mean_now") - F.col("mean_before")).alias("jitter_metric"), (F.col("mean_now") > F.col("mean_before") + threshold).alias("has_significant_jitter"), F.lit("jitter_dispersion").alias("method"), F.lit(threshold).alias("threshold"), F.lit(None).cast("double").alias("p_value"))


def ks_statistics(jit: DataFrame, periods: DataFrame) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic of the jitter in each period and before it.

    Both distributions are counts by value, summed in rising order within levels
    of the value; what the levels below add up to is a window over one row per
    level.
    """
    counts = in_periods(jit, periods).groupBy(*KEYS, "jitter").agg(F.count_if("current").alias("now"), F.count_if(~F.col("current")).alias("before")).withColumn("level", level("jitter"))
    whole = Window.partitionBy(*KEYS)
    below = whole.orderBy("level").rowsBetween(Window.unboundedPreceding, -1)
    add = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    levels = counts.groupBy(*KEYS, "level").agg(F.sum("now").alias("now"), F.sum("before").alias("before"))
    levels = levels.select(*KEYS, "level", add("now", below).alias("c_now"), add("before", below).alias("c_before"), add("now", whole).alias("n_now"), add("before", whole).alias("n_before")).where("n_now >= 2 and n_before >= 1")
    upto = Window.partitionBy(*KEYS, "level").orderBy("jitter").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    v = counts.withColumn("now", F.sum("now").over(upto)).withColumn("before", F.sum("before").over(upto)).join(levels, [*KEYS, "level"])
    gap: Column = F.abs((F.col("c_now") + F.col("now")) / F.col("n_now") - (F.col("c_before") + F.col("before")) / F.col("n_before"))
    return v.groupBy(*KEYS).agg(F.max(gap).alias("statistic"), F.max("n_now").alias("n_now"), F.max("n_before").alias("n_before"))


def ks_periods(jit: DataFrame, periods: DataFrame, significance: float = 0.05) -> DataFrame:
    """The test's verdict for each period."""
    s = ks_statistics(jit, periods).withColumn("p_value", ks_p_value("statistic", "n_before", "n_now"))
    return s.select(*KEYS, F.col("statistic").alias("jitter_metric"), (F.col("p_value") < significance).alias("has_significant_jitter"), F.lit("ks_test").alias("method"), F.lit(significance).alias("threshold"), "p_value")
