"""Windows over long series: ranges of rows with the neighbours that their windows reach.

No window here is partitioned by the series alone, unless over one row per
range.  ``placed`` numbers the rows of a series by counting per stretch of time
first; ``with_halo`` cuts the numbered rows into ranges of equal size and gives
each range the rows just before and after it as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A stretch of time: 4,096 bins of 15 minutes.
STRETCH_US = 4096 * 900_000_000
#: Rows in a range.
RANGE = 1 << 13


def order_of(series: DataFrame) -> list[str]:
    return ["epoch_us", "seq"] if "seq" in series.columns else ["epoch_us"]


def stretches(series: DataFrame, stretch: int = STRETCH_US) -> DataFrame:
    return series.withColumn("stretch", F.floor(F.col("epoch_us") / stretch))


def earlier_stretches():
    """The stretches of a series before each; there is one row per stretch."""
    return Window.partitionBy("series_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)


def placed(series: DataFrame, stretch: int = STRETCH_US) -> DataFrame:
    """With a dense index ``i`` from 0 and the series' length ``n``."""
    keyed = stretches(series, stretch)
    counts = keyed.groupBy("series_id", "stretch").agg(F.count("*").alias("rows"))
    counts = counts.select("series_id", "stretch", F.coalesce(F.sum("rows").over(earlier_stretches()), F.lit(0)).alias("first"), F.sum("rows").over(Window.partitionBy("series_id")).alias("n"))
    own = Window.partitionBy("series_id", "stretch").orderBy(*order_of(series))
    return keyed.join(counts, ["series_id", "stretch"]).withColumn("i", F.row_number().over(own) - 1 + F.col("first")).drop("stretch", "first")


def with_halo(numbered: DataFrame, before: int, after: int, size: int = RANGE) -> DataFrame:
    """Rows of ``placed`` with each ``range`` that needs them; ``own`` tells the range that a row belongs to."""
    first, last = F.ceil((F.col("i") - size + 1 - after) / size), F.floor((F.col("i") + before) / size)
    ranges = F.sequence(F.greatest(F.lit(0), first).cast("bigint"), F.least(last, F.floor((F.col("n") - 1) / size)).cast("bigint"))
    return numbered.withColumn("range", F.explode(ranges)).withColumn("own", F.col("range") == F.floor(F.col("i") / size))


def range_window():
    return Window.partitionBy("series_id", "range").orderBy("i")


def last_known(df: DataFrame, mark: str, name: str, order: str, span: float) -> DataFrame:
    """With the last non-null value of ``mark`` up to each row in the order of ``order``, carried over from stretch to stretch."""
    keyed = df.withColumn("stretch", F.floor(F.col(order) / span))
    lasts = keyed.groupBy("series_id", "stretch").agg(F.max_by(mark, F.when(F.col(mark).isNotNull(), F.col(order))).alias("carried"))
    before = lasts.select("series_id", "stretch", F.last("carried", ignorenulls=True).over(earlier_stretches()).alias("carried"))
    own = Window.partitionBy("series_id", "stretch").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = keyed.withColumn(name, F.last(mark, ignorenulls=True).over(own)).join(before, ["series_id", "stretch"])
    return found.withColumn(name, F.coalesce(name, "carried")).drop("stretch", "carried")
