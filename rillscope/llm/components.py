"""Connected components of a link table, by alternating large and small stars.

Every step is an aggregation with map-side combine and an equi-join; the links
never come to the driver.  The join of the large star brings the links of a
vertex together as rows, not as one value, and an adaptive join may split them.
Each round is written to shared storage, which cuts lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One star step on links (u, v) with u > v."""
    if large:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        moved = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u != v").distinct()


def _mark(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row.n, int(row.s or 0)


def connected_components(links: DataFrame, rounds: int = 64) -> DataFrame:
    """(id, component) of every vertex that is not the least of its component.

    ``links`` has two columns of ids, in any direction and number.  The least
    id of a component names it; vertices without a row name their own.
    """
    spark = links.sparkSession
    a, b = links.columns[:2]
    edges = materialize(spark, links.where(f"{a} is not null and {b} is not null and {a} != {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    before = _mark(edges)
    for _ in range(rounds):
        edges = materialize(spark, _star(_star(edges, True), False), "links")
        now = _mark(edges)
        if now == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        before = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
