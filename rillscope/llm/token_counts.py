"""Exact histogram of encoded lengths, and what its suffix sums answer.

Documents are aggregated by encoded length (a map-side combined count), so all
later work is on distinct lengths.  Prefix and suffix sums run in two levels,
within ranges of ``RANGE`` lengths and over the ranges' totals, so that no one
task sees every length.

For any context limit L, with the row of the least length >= L:
``truncated total = tokens_below + L * docs_at_least``; totals and quantiles
come from ``docs_at_most`` and ``tokens_at_least``.

Edge cases: a null text has length 0; null or repeated ``doc_id`` values count
as rows; an empty table gives an empty histogram; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize
from .byte_bpe import encoding, pre_tokens

RANGE = 256
CACHE_WORDS = 400_000


def encoded_lengths(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One column ``n_tokens``: the encoded length of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, cut = encoding(path, pattern)._encode_single_piece, pre_tokens(pattern)

        class Lengths(dict):
            def __missing__(self, word: str) -> int:
                n = self[word] = len(encode(word))
                return n

        known = Lengths()
        for b in batches:
            out = np.zeros(b.num_rows, np.int64)
            for i, text in enumerate(b.column("text")):
                out[i] = sum(map(known.__getitem__, cut(text.as_py() or "")))
                if len(known) > CACHE_WORDS:
                    known.clear()
            yield pa.RecordBatch.from_arrays([pa.array(out)], names=["n_tokens"])

    return docs.select("text").mapInArrow(run, "n_tokens bigint")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """The histogram of ``n_tokens`` with its running sums.

    Columns: n_tokens, docs, tokens, docs_at_most, docs_at_least, tokens_below,
    tokens_at_least, truncated_total (of all documents cut to n_tokens),
    share_at_most (the quantile that the length is).
    """
    counted = materialize(lengths.sparkSession, lengths.groupBy("n_tokens").agg(F.count("*").alias("docs")), "lengths")  # so texts are encoded once
    hist = counted.withColumn("tokens", F.col("n_tokens") * F.col("docs")).withColumn("range", F.floor(F.col("n_tokens") / RANGE))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # One row per RANGE lengths: as many as the longest document has thousands of tokens.
    ranges = hist.groupBy("range").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    ranges = ranges.select("range", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in "dt"), *(F.sum(c).over(every).alias(f"{c}_all") for c in "dt"))
    inner = Window.partitionBy("range").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    h = hist.join(ranges, "range")
    at_most, up_to = F.sum("docs").over(inner) + F.col("d_before"), F.sum("tokens").over(inner) + F.col("t_before")
    h = h.withColumn("docs_at_most", at_most).withColumn("tokens_below", up_to - F.col("tokens"))
    h = h.withColumn("docs_at_least", F.col("d_all") - F.col("docs_at_most") + F.col("docs")).withColumn("tokens_at_least", F.col("t_all") - F.col("tokens_below"))
    return h.select("n_tokens", "docs", "tokens", "docs_at_most", "docs_at_least", "tokens_below", "tokens_at_least", (F.col("tokens_below") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_total"), (F.col("docs_at_most") / F.col("d_all")).alias("share_at_most"))


def truncated_total(histogram: DataFrame, limit: int) -> int:
    """Tokens that remain if every document is cut to ``limit`` tokens."""
    row = histogram.where(F.col("n_tokens") >= limit).agg(F.min_by(F.struct("tokens_below", "docs_at_least"), "n_tokens").alias("r")).first().r
    if row is None:
        return histogram.agg(F.sum("tokens")).first()[0] or 0
    return row.tokens_below + limit * row.docs_at_least


def length_quantile(histogram: DataFrame, share: float) -> int | None:
    """The least length that at least ``share`` of all documents do not exceed."""
    return histogram.where(F.col("share_at_most") >= share).agg(F.min("n_tokens")).first()[0]
