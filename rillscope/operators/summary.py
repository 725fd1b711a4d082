"""Aggregates over inferences, jumps and change points, and plot-ready relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranges import placed, range_window, with_halo

#: Sequence numbers in a stretch.
SEQ_STRETCH = 1 << 20


def _span():
    return F.col("end_epoch") - F.col("start_epoch")


def _when(c):
    return F.when(F.col("is_congested"), c)


def time_summary(inf: DataFrame) -> DataFrame:
    """Periods and durations, the congested share of time, the mean confidence."""
    s = inf.groupBy("series_id").agg(F.count("*").alias("total_periods"), F.count_if("is_congested").alias("congested_periods"), (F.max("end_epoch") - F.min("start_epoch")).alias("total_duration"), F.coalesce(F.sum(_when(_span())), F.lit(0.0)).alias("congestion_duration"), F.coalesce(F.avg(_when(F.col("confidence"))), F.lit(0.0)).alias("average_confidence"))
    return s.withColumn("congestion_ratio", F.when(F.col("total_duration") > 0, F.col("congestion_duration") / F.col("total_duration")).otherwise(0.0))


def count_summary(inf: DataFrame) -> DataFrame:
    """The congested share by count and by summed durations."""
    return inf.groupBy("series_id").agg(F.count("*").alias("total_periods"), F.count_if("is_congested").alias("congested_periods"), (F.count_if("is_congested") / F.count("*")).alias("congestion_ratio"), (F.coalesce(F.sum(_when(_span())), F.lit(0.0)) / F.sum(_span())).alias("congestion_time_ratio"))


def export_summary(inf: DataFrame) -> DataFrame:
    """What a summary file holds: counts, time range and confidence of the congested periods."""
    c = _when(F.col("confidence"))
    return inf.groupBy("series_id").agg(F.count("*").alias("total_periods"), F.count_if("is_congested").alias("congested_periods"), (F.count_if("is_congested") / F.count("*")).alias("congestion_ratio"), F.coalesce(F.sum(_when(_span())), F.lit(0.0)).alias("congestion_duration"), F.min("start_epoch").alias("range_start"), F.max("end_epoch").alias("range_end"), F.avg(c).alias("conf_mean"), F.median(c).alias("conf_median"), F.min(c).alias("conf_min"), F.max(c).alias("conf_max"))


def jump_statistics(jumps: DataFrame) -> DataFrame:
    """Counts and magnitudes of the jumps."""
    m = F.when(F.col("has_jump"), F.col("magnitude"))
    return jumps.groupBy("series_id").agg(F.count("*").alias("total_periods"), F.count_if("has_jump").alias("jumps"), (F.count_if("has_jump") / F.count("*")).alias("jump_ratio"), F.avg(m).alias("mean_magnitude"), F.max(m).alias("max_magnitude"), F.min(m).alias("min_magnitude"))


def dashboard_statistics(inf: DataFrame, cps: DataFrame) -> DataFrame:
    """Durations and confidences of the congested periods, change points and their rate per hour."""
    d, c = _when(_span()), _when(F.col("confidence"))
    a = inf.groupBy("series_id").agg(F.sum(d).alias("sum_duration"), F.avg(d).alias("avg_duration"), F.min(d).alias("min_duration"), F.max(d).alias("max_duration"), F.avg(c).alias("avg_confidence"), F.min(c).alias("min_confidence"), F.max(c).alias("max_confidence"), ((F.max("end_epoch") - F.min("start_epoch")) / 3600).alias("hours"))
    n = cps.groupBy("series_id").agg(F.count("*").alias("change_points"))
    return a.join(n, "series_id", "left").withColumn("change_points_per_hour", F.when(F.col("hours") > 0, F.col("change_points") / F.col("hours")))


def hour_histogram(inf: DataFrame) -> DataFrame:
    """Normal and congested periods by hour of day of their start."""
    hour = F.pmod(F.floor(F.col("start_epoch") / 3600), F.lit(24)).cast("int")
    return inf.groupBy(hour.alias("hour")).agg(F.count_if(~F.col("is_congested")).alias("normal"), F.count_if("is_congested").alias("congested"))


def histogram(df: DataFrame, value, bins: int = 20) -> DataFrame:
    """Counts in ``bins`` equal ranges from the least to the largest value."""
    v = df.select(value.cast("double").alias("v"), F.lit(1).alias("k"))
    edges = F.broadcast(v.groupBy("k").agg(F.min("v").alias("lo"), F.max("v").alias("hi")))  # one row
    width = (F.col("hi") - F.col("lo")) / bins
    slot = F.when(width > 0, F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0).cast("int")
    return v.join(edges, "k").groupBy(slot.alias("bin")).agg(F.count("*").alias("n"))


def heatmap(inf: DataFrame) -> DataFrame:
    """(series_id, row, position, value): a matrix of two rows, the confidence and the state of each period in order."""
    w = Window.partitionBy("series_id").orderBy("start_epoch")
    cells = F.array(F.struct(F.lit("confidence").alias("row"), F.col("confidence").alias("value")), F.struct(F.lit("congested").alias("row"), F.col("is_congested").cast("double").alias("value")))
    placed = inf.withColumn("position", F.row_number().over(w) - 1)  # before the rows are doubled
    return placed.select("series_id", "position", F.explode(cells).alias("c")).select("series_id", "c.row", "position", "c.value")


def congested_only(inf: DataFrame) -> DataFrame:
    return inf.where("is_congested")


def first_congested(inf: DataFrame, most: int = 5) -> DataFrame:
    """The first ``most`` congested periods of each series."""
    w = Window.partitionBy("series_id").orderBy("start_epoch")
    return congested_only(inf).withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).drop("r").orderBy("series_id", "start_epoch")


def durations_by_source(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Number and mean, least and largest hours of the congested periods, expected (starts, ends, congestion) and detected."""
    one = expected.where("congestion = 1").select(F.lit("expected").alias("origin"), ((F.col("ends") - F.col("starts")) / 3600).alias("h"))
    two = congested_only(found).select(F.lit("detected").alias("origin"), (_span() / 3600).alias("h"))
    return one.unionByName(two).groupBy("origin").agg(F.count("*").alias("n"), F.avg("h").alias("mean_hours"), F.min("h").alias("min_hours"), F.max("h").alias("max_hours"))


def service_statistics(requests: DataFrame, last: int = 100) -> DataFrame:
    """Running counts of requests (``seq``, ``seconds``, ``ok``) by service, and the mean time of the last ones.

    Requests are numbered by stretches of ``seq``; a range of them gets the
    ``last`` before it, and what the ranges before add up to is one row each.
    """
    rows = requests.select(F.col("service").alias("series_id"), F.col("seq").alias("epoch_us"), "seconds", (~F.col("ok")).cast("int").alias("bad"))
    cut = with_halo(placed(rows, SEQ_STRETCH), last - 1, 0)
    own = cut.where("own")
    totals = own.groupBy("series_id", "range").agg(F.sum("bad").alias("bad_here"))
    earlier = Window.partitionBy("series_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("series_id", "range", F.coalesce(F.sum("bad_here").over(earlier), F.lit(0)).alias("bad_before"))
    w = range_window()
    running = F.sum(F.when(F.col("own"), F.col("bad")).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    seen = cut.withColumn("errors", running).withColumn("recent_seconds", F.avg("seconds").over(w.rowsBetween(1 - last, 0))).where("own").join(totals, ["series_id", "range"])
    return seen.select(F.col("series_id").alias("service"), F.col("epoch_us").alias("seq"), (F.col("i") + 1).alias("requests"), (F.col("errors") + F.col("bad_before")).alias("errors"), "recent_seconds")


def step_series(inf: DataFrame) -> DataFrame:
    """Start and end points of all periods with the state as 0 or 1."""
    return inf.select("series_id", F.explode(F.array(F.struct(F.col("start_epoch").alias("epoch"), F.lit(0).alias("edge")), F.struct(F.col("end_epoch").alias("epoch"), F.lit(1).alias("edge")))).alias("p"), F.col("is_congested").cast("int").alias("state")).select("series_id", "p.epoch", "p.edge", "state")


def duration_points(inf: DataFrame) -> DataFrame:
    """Minutes and confidence of each period."""
    return inf.select("series_id", (_span() / 60).alias("minutes"), "confidence", "is_congested")


def axis_extent(*frames: DataFrame) -> DataFrame:
    """Least and largest epoch over several relations."""
    from functools import reduce

    ranges = [f.agg(F.min("epoch").alias("lo"), F.max("epoch").alias("hi")) for f in frames]
    return reduce(DataFrame.unionByName, ranges).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def comparison(cps: DataFrame) -> DataFrame:
    """Change points, mean confidence and its sample deviation by algorithm."""
    return cps.groupBy("algorithm").agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"), F.coalesce(F.stddev_samp("confidence"), F.lit(0.0)).alias("std_confidence"))


def report_metadata(samples: DataFrame, minima: DataFrame, inf: DataFrame) -> DataFrame:
    """Points, bins, periods and hours covered, by series."""
    a = samples.groupBy("series_id").agg(F.count("*").alias("points"), ((F.max("epoch_us") - F.min("epoch_us")) / 3.6e9).alias("hours"))
    return a.join(minima.groupBy("series_id").agg(F.count("*").alias("bins")), "series_id", "left").join(inf.groupBy("series_id").agg(F.count("*").alias("periods"), F.count_if("is_congested").alias("congested")), "series_id", "left")


def accuracy(inf: DataFrame, expected: int) -> DataFrame:
    """Congested periods in percent of the expected number."""
    return inf.groupBy("series_id").agg((F.count_if("is_congested") / F.lit(expected) * 100).alias("accuracy"))


def overlap(found: DataFrame, truth: DataFrame, *by: str) -> DataFrame:
    """Precision, recall and F1 of congested time, over all or for each value of ``by``; both sides (start_epoch, end_epoch) without overlaps of their own.

    An interval join on day buckets.  Where one side has nothing the figure that
    would divide by it is null.
    """
    cut = lambda df, p: df.select(*by, F.col("start_epoch").alias(f"{p}s"), F.col("end_epoch").alias(f"{p}e")).withColumn("day", F.explode(F.sequence(F.floor(F.col(f"{p}s") / 86400), F.floor(F.col(f"{p}e") / 86400))))
    clip = lambda c, f: f(c, F.col("day") * 86400.0 if f is F.greatest else (F.col("day") + 1) * 86400.0)
    shared = cut(found, "f").join(cut(truth, "t"), [*by, "day"]).select(*by, (clip(F.least("fe", "te"), F.least) - clip(F.greatest("fs", "ts"), F.greatest)).alias("s")).where("s > 0")
    side = lambda df, name, v: df.select(*by, *((v if n == name else F.lit(0.0)).alias(n) for n in ("both", "found", "truth")))
    sums = side(shared, "both", F.col("s")).unionByName(side(found, "found", _span())).unionByName(side(truth, "truth", _span()))
    m = sums.groupBy(*by).agg(*(F.coalesce(F.sum(n), F.lit(0.0)).alias(n) for n in ("both", "found", "truth")))
    m = m.select(*by, F.try_divide("both", "found").alias("precision"), F.try_divide("both", "truth").alias("recall"))
    return m.withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def benchmark_table(runs: DataFrame, *keys: str, measures: tuple[str, ...] = ("seconds", "n", "confidence")) -> DataFrame:
    """By ``keys`` (the algorithm by default): moments and range of what benchmark runs measured, and successes."""
    return runs.groupBy(*(keys or ("algorithm",))).agg(*(f(c).alias(f"{c}_{n}") for c in measures for f, n in ((F.avg, "mean"), (F.stddev_samp, "std"), (F.min, "min"), (F.max, "max"))), F.count_if(F.col("n") > 0).alias("successes"))


def extreme_algorithms(runs: DataFrame, measure: str) -> DataFrame:
    """By dataset, the algorithm with the least and the largest measure; ties go to the first by name."""
    return runs.groupBy("dataset").agg(F.min_by("algorithm", F.struct(measure, "algorithm")).alias("least"), F.min_by("algorithm", F.struct(-F.col(measure), "algorithm")).alias("largest"))
