"""Congestion from jumps and jitter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .periods import KEYS
from .ranges import last_known
from .windows import with_previous


def evidence(jumps: DataFrame, jitters: DataFrame, tolerance: float | None = None) -> DataFrame:
    """Jumps with the jitter verdict of the same period.

    Both come from the same change points, so the key is (series_id, cp_idx).
    With a tolerance, periods from elsewhere match if both ends differ by less.
    """
    j = jitters.select("series_id", F.col("cp_idx").alias("jitter_idx"), F.col("start_epoch").alias("j_start"), F.col("end_epoch").alias("j_end"), "has_significant_jitter", "jitter_metric", "method", F.col("threshold").alias("jitter_threshold"), "p_value")
    if tolerance is None:
        return jumps.join(j.withColumnRenamed("jitter_idx", "cp_idx"), ["series_id", "cp_idx"]).drop("j_start", "j_end")
    width = max(tolerance, 1e-9)
    left = jumps.withColumn("cell", F.explode(F.array(*(F.floor(F.col("start_epoch") / width) + k for k in (-1, 0, 1)))))
    near = left.join(j.withColumn("cell", F.floor(F.col("j_start") / width)), ["series_id", "cell"]).where((F.abs(F.col("start_epoch") - F.col("j_start")) < tolerance) & (F.abs(F.col("end_epoch") - F.col("j_end")) < tolerance))
    first = Window.partitionBy("series_id", "cp_idx").orderBy("jitter_idx")
    return near.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r", "cell", "jitter_idx", "j_start", "j_end")


def _held(df: DataFrame, mark: Column, span_s: float | None) -> DataFrame:
    """``df`` with ``held``, the last known ``mark`` of the series; with ``span_s`` in stretches of so many seconds at once."""
    if span_s:
        return last_known(df.withColumn("mark", mark), "mark", "held", "start_epoch", span_s).drop("mark")
    upto = Window.partitionBy("series_id").orderBy("start_epoch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("held", F.last(mark, ignorenulls=True).over(upto))


def congestion(ev: DataFrame, span_s: float | None = None) -> DataFrame:
    """State and confidence: a jump with jitter sets it, no jump resets it, a jump alone holds it.

    Periods are as few as change points, so they are put in order by series;
    ``span_s`` cuts a series into stretches of so many seconds, which costs a
    second reading of ``ev``.
    """
    mark = F.when(F.col("has_jump") & F.col("has_significant_jitter"), True).when(~F.col("has_jump"), False)
    out = _held(ev, mark, span_s).select(*ev.columns, F.coalesce("held", F.lit(False)).alias("is_congested"))
    bonus = F.when(F.col("magnitude") > 2 * F.col("threshold"), 0.1).otherwise(0.0)
    return out.withColumn("confidence", F.when(F.col("is_congested"), F.least(F.lit(1.0), 0.8 + bonus)).otherwise(0.0))


def independent(ev: DataFrame) -> DataFrame:
    """Each period judged alone, with a confidence by kind of evidence."""
    jump, jit, mag, thr, p = F.col("has_jump"), F.col("has_significant_jitter"), F.col("magnitude"), F.col("threshold"), F.col("p_value")
    both = 0.8 + F.when(mag > 2 * thr, 0.1).otherwise(0.0) + F.when(p.isNotNull(), 0.1 * (1 - 20 * p)).otherwise(0.0)
    strong = F.when(p.isNotNull(), p < 0.001).otherwise(F.col("jitter_metric") > 2 * F.col("jitter_threshold"))
    score = F.when(jump & jit, both).when(jump, 0.4 + F.when(mag > 3 * thr, 0.2).otherwise(0.0)).when(jit, 0.2 + F.when(strong, 0.3).otherwise(0.0)).otherwise(0.0)
    return ev.withColumn("is_congested", jump | jit).withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def smoothed(inferences: DataFrame, span_s: float | None = None) -> DataFrame:
    """Flip single periods that differ from both neighbours, one after another in time.

    A flip is seen by the next period.  A period that differs from the next one
    takes the state before it, flipped or not; so the states are those of the
    periods that agree with the next one (and of the first and last), each held
    until the next such period.
    """
    rows = inferences.select("series_id", "start_epoch", "end_epoch", "cp_idx", "is_congested", "confidence")
    if span_s:
        near = with_previous(with_previous(rows, "is_congested", "before", "start_epoch", span_s), "is_congested", "after", "start_epoch", span_s, ahead=True)
    else:
        w = Window.partitionBy("series_id").orderBy("start_epoch")
        near = rows.withColumn("before", F.lag("is_congested").over(w)).withColumn("after", F.lead("is_congested").over(w))
    sure = F.col("before").isNull() | F.col("after").isNull() | (F.col("after") == F.col("is_congested"))
    held = _held(near, F.when(sure, F.col("is_congested")), span_s)
    flipped = F.col("held") != F.col("is_congested")
    return held.select("series_id", "start_epoch", "end_epoch", "cp_idx", F.col("held").alias("is_congested"), F.when(flipped, F.least("confidence", F.lit(0.3))).otherwise(F.col("confidence")).alias("confidence"))


def as_inferences(ev: DataFrame) -> DataFrame:
    """The nested result relation."""
    jump = F.struct("has_jump", "magnitude", "threshold").alias("latency_jump")
    jit = F.struct("has_significant_jitter", "jitter_metric", "method", F.col("jitter_threshold").alias("threshold"), "p_value").alias("jitter_analysis")
    return ev.select(*KEYS, "is_congested", "confidence", jump, jit)
