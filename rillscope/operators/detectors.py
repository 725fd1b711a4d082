"""Change-point detectors and the filters over their results.

The window scores are differences of prefix sums at an offset, so the window may
depend on the series' length.  Accepting in order and keeping a gap are folds,
made in ranges of time at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import keep_apart
from .ranges import earlier_stretches, stretches


def prefix_sums(series: DataFrame) -> DataFrame:
    """Index, length and running sums of the centred values and their squares before each row.

    Sums run within stretches of time; what the stretches before add up to is a
    window over one row per stretch.
    """
    keyed = stretches(series)
    whole, earlier = Window.partitionBy("series_id"), earlier_stretches()
    sizes = keyed.groupBy("series_id", "stretch").agg(F.count("*").alias("rows"), F.sum("rtt_value").alias("total"))
    sizes = sizes.select("series_id", "stretch", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("first"), F.sum("rows").over(whole).alias("n"), (F.sum("total").over(whole) / F.sum("rows").over(whole)).alias("mean"))
    own = Window.partitionBy("series_id", "stretch").orderBy("epoch_us")
    s = keyed.join(sizes, ["series_id", "stretch"]).withColumn("x", F.col("rtt_value") - F.col("mean")).withColumn("i", F.row_number().over(own) - 1 + F.col("first"))
    x, y = F.col("x"), F.col("x") * F.col("x")
    sums = s.groupBy("series_id", "stretch").agg(F.sum(x).alias("a"), F.sum(y).alias("b"))
    zero, upto = F.lit(0.0), own.rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("series_id", "stretch", F.coalesce(F.sum("a").over(earlier), zero).alias("a"), F.coalesce(F.sum("b").over(earlier), zero).alias("b"), F.sum("a").over(whole).alias("t1"), F.sum("b").over(whole).alias("t2"))
    s = s.withColumn("s1", F.coalesce(F.sum(x).over(upto), zero)).withColumn("s2", F.coalesce(F.sum(y).over(upto), zero)).join(sums, ["series_id", "stretch"])
    return s.withColumn("s1", F.col("s1") + F.col("a")).withColumn("s2", F.col("s2") + F.col("b")).drop("stretch", "first", "mean", "a", "b")


def two_sided(series: DataFrame, width: Column, where: Column) -> DataFrame:
    """Means and population variances of ``width`` rows before and from each row that ``where`` picks.

    ``width`` is made from the series' length ``n``.  A row of the prefix sums
    is wanted at three places: width rows later, in its own and width rows
    before; it goes there, and each place that is picked gathers its three.
    """
    p = prefix_sums(series).withColumn("w", width)
    to = F.explode(F.array(*(F.struct((F.col("i") + k * F.col("w")).alias("i"), F.lit(side).alias("side")) for side, k in (("a", 1), ("m", 0), ("b", -1)))))
    sent = p.select("series_id", "n", "w", "epoch_us", "epoch", "s1", "s2", "t1", "t2", to.alias("to")).select("series_id", "to.*", "n", "w", "epoch_us", "epoch", "s1", "s2", "t1", "t2")
    sent = sent.where(where & (F.col("i") >= F.col("w")) & (F.col("i") <= F.col("n") - F.col("w")))
    of = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    sums = {f"{c}_{side}": of(side, c) for c in ("s1", "s2") for side in "amb"}
    both = sent.groupBy("series_id", "i").agg(*(F.max(c).alias(c) for c in ("n", "w", "t1", "t2")), of("m", "epoch_us").alias("epoch_us"), of("m", "epoch").alias("epoch"), *(c.alias(name) for name, c in sums.items())).where("epoch_us is not null")
    s1b, s2b = F.coalesce("s1_b", "t1"), F.coalesce("s2_b", "t2")  # at i + w = n the sums are the totals
    w = F.col("w")
    m_l, m_r = (F.col("s1_m") - F.col("s1_a")) / w, (s1b - F.col("s1_m")) / w
    v_l, v_r = (F.col("s2_m") - F.col("s2_a")) / w - m_l * m_l, (s2b - F.col("s2_m")) / w - m_r * m_r
    zero = F.lit(0.0)
    return both.select("series_id", "i", "n", "w", "epoch_us", "epoch", m_l.alias("mean_l"), m_r.alias("mean_r"), F.greatest(v_l, zero).alias("var_l"), F.greatest(v_r, zero).alias("var_r"))


def _width30() -> Column:
    return F.greatest(F.lit(20), F.floor(F.col("n") / 30)).cast("int")


def _stepped() -> Column:
    return (F.col("n") >= 10) & (F.pmod(F.col("i") - F.col("w"), F.greatest(F.lit(5), F.floor(F.col("w") / 4)).cast("int")) == 0) & (F.col("i") < F.col("n") - F.col("w"))


def _var_score() -> tuple[Column, Column, Column]:
    v_l, v_r = F.greatest("var_l", F.lit(0.001)), F.greatest("var_r", F.lit(0.001))
    return v_l, v_r, F.log(F.greatest(v_l / v_r, v_r / v_l)) * F.sqrt(F.col("w").cast("double"))


def bayes_scores(series: DataFrame) -> DataFrame:
    """Two-window scores of mean and variance changes, weighed by window sizes."""
    v_l, v_r, var_score = _var_score()
    mean_score = F.abs(F.col("mean_r") - F.col("mean_l")) / F.sqrt((v_l + v_r) / 2) * F.sqrt(F.col("w") / 2)
    return two_sided(series, _width30(), _stepped()).withColumn("score", mean_score + 0.8 * var_score)


def level_shift_scores(series: DataFrame) -> DataFrame:
    """Two-window scores of level shifts and variance changes."""
    v_l, v_r, var_score = _var_score()
    pooled = F.sqrt((v_l + v_r) / 2)
    return two_sided(series, _width30(), _stepped()).withColumn("score", F.abs(F.col("mean_r") - F.col("mean_l")) / pooled + 0.5 * var_score)


def welch_scores(series: DataFrame) -> DataFrame:
    """Welch statistics of 30 rows (a sixth of a short series) on either side of each row."""
    width = F.least(F.lit(30), F.floor(F.col("n") / 6)).cast("int")
    moments = series.groupBy("series_id").agg(F.avg("rtt_value").alias("mu"), F.stddev_pop("rtt_value").alias("sd"))
    scaled = series.join(moments, "series_id").withColumn("rtt_value", (F.col("rtt_value") - F.col("mu")) / (F.col("sd") + 1e-8)).drop("mu", "sd")
    s = two_sided(scaled, width, (F.col("n") >= 10) & (F.col("i") < F.col("n") - F.col("w")))
    pooled = F.col("var_l") / F.col("w") + F.col("var_r") / F.col("w")
    return s.withColumn("score", F.when((F.col("w") >= 5) & (pooled > 1e-8), F.abs(F.col("mean_l") - F.col("mean_r")) / F.sqrt(pooled)).otherwise(0.0))


def keep_gap(candidates: DataFrame, gap: float) -> DataFrame:
    """Candidates in time order, each at least ``gap`` after the one kept before."""
    return keep_apart(candidates, gap)


def filter_change_points(candidates: DataFrame, gap: float, most: int | None = None) -> DataFrame:
    """Minimum gap, where a surer candidate replaces the one before it, then the surest ``most``."""
    out = keep_apart(candidates, gap, surest=True)
    return top_confidence(out, most) if most else out


def top_confidence(cps: DataFrame, most: int) -> DataFrame:
    """The ``most`` surest change points of each series; ties go to the earlier."""
    w = Window.partitionBy("series_id").orderBy(F.col("confidence").desc(), "epoch")
    return cps.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).drop("r")


def _accept(scores: DataFrame, threshold: float, gap: float, factor: float, limit: int, keep: int) -> DataFrame:
    thr = 0.2 * threshold / 1.5
    cand = scores.where(F.col("score") > thr).select("series_id", "epoch", F.least(F.lit(1.0), F.col("score") / (factor * thr)).alias("confidence"))
    kept = keep_gap(cand, gap)
    n = F.count("*").over(Window.partitionBy("series_id"))
    r = F.row_number().over(Window.partitionBy("series_id").orderBy(F.col("confidence").desc(), "epoch"))
    return kept.withColumn("c", n).withColumn("r", r).where((F.col("c") <= limit) | (F.col("r") <= keep)).drop("c", "r")


def detect_bayes_windows(series: DataFrame, threshold: float = 0.25, gap: float = 1800) -> DataFrame:
    """Change points of the two-window Bayes-like score."""
    return keep_gap(_accept(bayes_scores(series), threshold, gap, 2.0, 45, 40), gap).withColumn("algorithm", F.lit("rbeast_fallback"))


def detect_level_shifts(series: DataFrame, threshold: float = 0.25, gap: float = 1800) -> DataFrame:
    """Change points of the level-shift score."""
    return _accept(level_shift_scores(series), threshold, gap, 1.5, 45, 35).withColumn("algorithm", F.lit("adtk_fallback"))


def welch_candidates(series: DataFrame, threshold: float = 0.25) -> DataFrame:
    """Rows whose Welch statistic is high for its series, with confidence and priority."""
    s = welch_scores(series)
    # Rows without a full window on either side score zero and count in the moments.
    scored = s.groupBy("series_id").agg(F.count("*").alias("c"), F.sum("score").alias("a"), F.sum(F.col("score") * F.col("score")).alias("b"), F.max("n").alias("n"))
    m = scored.select("series_id", (F.col("a") / F.col("n")).alias("mu"), F.sqrt(F.greatest(F.col("b") / F.col("n") - F.col("a") * F.col("a") / (F.col("n") * F.col("n")), F.lit(0.0))).alias("sd"))
    t = s.join(m, "series_id")
    level = lambda k, least: F.greatest(F.col("mu") + k * threshold * F.col("sd"), F.lit(least))
    t = t.where(F.col("score") > level(0.5, 0.3))
    return t.select("series_id", "epoch", "score", F.least(F.lit(1.0), F.col("score") / 10).alias("confidence"), F.when(F.col("score") > level(3, 1.0), 1).when(F.col("score") > level(1.5, 0.7), 2).otherwise(3).alias("priority"))


def grid_cells(candidates: DataFrame, bounds: DataFrame, cells: int = 35) -> DataFrame:
    """Candidates with each cell of an even time grid that holds them, both ends included.

    ``bounds`` has (series_id, first_epoch, last_epoch).  A candidate on a
    border is in both cells: the cell number is arithmetic, the neighbour is
    added where the value lies on its edge.
    """
    c = candidates.join(bounds, "series_id").withColumn("cell_size", (F.col("last_epoch") - F.col("first_epoch")) / cells)
    k = F.floor((F.col("epoch") - F.col("first_epoch")) / F.col("cell_size"))
    c = c.withColumn("cell", F.explode(F.array(k - 1, k, k + 1)))
    lo = F.col("first_epoch") + F.col("cell") * F.col("cell_size")
    return c.where((F.col("cell") >= 0) & (lo < F.col("last_epoch")) & (F.col("epoch") >= lo) & (F.col("epoch") <= lo + F.col("cell_size")))


def best_per_cell(candidates: DataFrame, bounds: DataFrame, cells: int = 35) -> DataFrame:
    """The best candidate of each cell: lowest priority number, then highest score, then earliest."""
    w = Window.partitionBy("series_id", "cell").orderBy("priority", F.col("score").desc(), "epoch")
    return grid_cells(candidates, bounds, cells).withColumn("r", F.row_number().over(w)).where("r = 1").select("series_id", "cell", "epoch", "score", "confidence", "priority")


def unused(candidates: DataFrame, used: DataFrame) -> DataFrame:
    """Candidates whose epoch is not among the used ones (an anti-join)."""
    return candidates.join(used.select("series_id", "epoch").distinct(), ["series_id", "epoch"], "left_anti")
