"""Exact quantiles by selection: a few passes of histograms, each over the rows that may still hold a wanted rank.

The first pass counts rows by key and bucket of a rising function of the value;
the next ones cut each bucket that holds a wanted rank, between its least and
largest value, into PARTS again.  Counting combines before its shuffle, so the
largest task does not grow with the rows of a key, and no task holds the values
of a key.  A bucket ends when all its values are equal or when SMALL rows are
left, which are sorted.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import shared_path

PARTS = 4096
SMALL = 10_000


def level(x: str) -> Column:
    """A bucket that rises with the value: steps of 1/64 of its logarithm, from a millionth on."""
    return F.floor(F.signum(x) * F.log1p(F.abs(F.col(x)) * 1e6) * 64)


def _kept(df: DataFrame) -> DataFrame:
    path = shared_path(df.sparkSession, f"quantiles-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _part() -> Column:
    """The part of its bucket that a value is in; halves, so that no difference overflows."""
    share = (F.col("x") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
    return F.least(F.lit(PARTS - 1), F.floor(share * PARTS))


def ranked_values(df: DataFrame, column: str, ranks: Column, by: list[str]) -> DataFrame:
    """(by, total, rank, value): the values at some ranks (from 0) of each key.

    ``ranks``: an array of ranks, made from ``total``, the key's number of values.
    Nulls and NaN do not count.
    """
    named, by = by, [f"by_{k}" for k in range(len(by))]
    x = df.select(*(F.col(c).alias(b) for c, b in zip(named, by, strict=True)), F.col(column).cast("double").alias("x")).where("x is not null and not isnan(x)").withColumn("bucket", level("x").cast("string"))
    each = x.groupBy(*by, "bucket").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    order = Window.partitionBy(*by).orderBy("lo")
    each = each.withColumn("total", F.sum("n").over(Window.partitionBy(*by))).withColumn("before", F.sum("n").over(order) - F.col("n"))
    wanted = each.withColumn("rank", F.explode(F.filter(F.array_distinct(ranks), lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("n")))))
    wanted = _kept(wanted.select(*by, "total", F.col("rank").cast("bigint").alias("rank"), "bucket", "before", "n", "lo", "hi"))
    done = []
    while True:
        done.append(wanted.where("lo = hi").select(*by, "total", "rank", F.col("lo").alias("value")))
        open_ = wanted.where("lo < hi")
        largest = open_.agg(F.max("n")).first()[0]
        if largest is None:
            break
        x = x.select(*by, "x", "bucket").join(open_.select(*by, "bucket", "lo", "hi").distinct(), [*by, "bucket"])
        if largest <= SMALL:
            few = x.groupBy(*by, "bucket").agg(F.sort_array(F.collect_list("x")).alias("all"))
            done.append(open_.join(few, [*by, "bucket"]).select(*by, "total", "rank", F.get("all", (F.col("rank") - F.col("before")).cast("int")).alias("value")))
            break
        x = _kept(x.withColumn("part", _part()))
        cut = x.groupBy(*by, "bucket", "part").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        inside = Window.partitionBy(*by, "bucket").orderBy("part")
        cut = cut.withColumn("inner", F.sum("n").over(inside) - F.col("n"))
        # The other columns of the old bucket are not wanted any more.
        wanted = open_.select(*by, "total", "rank", "bucket", "before").join(cut, [*by, "bucket"]).where("rank >= before + inner and rank < before + inner + n")
        name = F.concat_ws("/", "bucket", "part")
        wanted = _kept(wanted.select(*by, "total", "rank", name.alias("bucket"), (F.col("before") + F.col("inner")).alias("before"), "n", "lo", "hi"))
        x = x.withColumn("bucket", name)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(*(F.col(b).alias(c) for c, b in zip(named, by, strict=True)), "total", "rank", "value")


def exact_quantiles(df: DataFrame, column: str, shares: list[float], by: list[str]) -> DataFrame:
    """(by, share, value) of each key, interpolated between neighbours in rank; keys without values have no rows."""
    place = lambda p: (F.col("total") - 1) * F.lit(float(p))
    values = ranked_values(df, column, F.flatten(F.array(*(F.array(F.floor(place(p)), F.ceil(place(p))) for p in shares))), by)
    rows = values.withColumn("share", F.explode(F.array(*map(F.lit, map(float, shares))))).withColumn("place", (F.col("total") - 1) * F.col("share"))
    near = rows.where((F.col("rank") == F.floor("place")) | (F.col("rank") == F.ceil("place")))
    low, high = F.min_by("value", "rank"), F.max_by("value", "rank")
    return near.groupBy(*by, "share").agg((low + (high - low) * (F.max("place") - F.floor(F.max("place")))).alias("value"))
