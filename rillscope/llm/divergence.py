r"""Source divergence audit: how far the words of each source are from those of the other sources of its language.

Terms are matches of TERM, with only A-Z lower-cased.  A language keeps the
terms that MIN_DOCS of its documents hold.  Each (language, source) group and
each language as a whole gives every kept term a smoothed share p in parts of
10^9, and the divergence of two shares is (p - q)^2 / (p + q); all arithmetic
is on integers.

Plain relations: matches are exploded and counted, block by block of text and
then over all (matches are found by turning the bytes that TERM leaves out into
spaces, which takes a fraction of the time of a regular expression); groups are crossed with the kept vocabulary by a join on the language
(salted by term, so that no language is one key) to fill in zeros; that table
meets itself on language and term; sums are ranked by a window per group.

Defined cases: a null text, language or source counts as ''; a group without
terms still has its pairs; a language without kept terms has pairs of value 0;
a language of one source has no pairs; an empty table gives no rows; a repeated
row is a document of its own; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import blocks, distinct, materialize, words_of

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK_BYTES = 8 << 20
MIN_DOCS = 10
TOP = 10
#: Parts into which a language's vocabulary is dealt where groups meet it.
SALTS = 64


def _of(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def _share(count: str, total: str, size: str) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 size))."""
    return F.expr(f"1 + cast(1000000000 as decimal(20, 0)) * (coalesce({count}, 0) + 2) div ({total} + 2 * {size})")


def _apart(p: str, q: str) -> Column:
    return F.expr(f"({p} - {q}) * ({p} - {q}) div ({p} + {q})")


def _byte_table() -> np.ndarray:
    """What TERM leaves out becomes a space, A-Z become a-z; bytes of characters beyond ASCII stay."""
    table = np.arange(256, dtype=np.uint8)
    table[:128] = ord(" ")
    for upper, lower in zip(UPPER, LOWER, strict=True):
        table[[ord(upper), ord(lower)]] = ord(lower)
    return table


def _block_counts(block: pa.RecordBatch) -> pa.RecordBatch:
    """(lang, source, term, n, in_docs) of a block's rows."""
    texts = pc.fill_null(block.column("text"), "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    plain = pa.py_buffer(_byte_table()[np.frombuffer(data or b"", np.uint8)].tobytes())
    codes, ends, terms = words_of(pa.LargeStringArray.from_buffers(len(texts), offsets, plain, offset=texts.offset))
    lang, source = block.column("lang").dictionary_encode(), block.column("source").dictionary_encode()
    group = np.asarray(lang.indices, np.int64) * max(1, len(source.dictionary)) + np.asarray(source.indices, np.int64)
    size = max(1, len(terms))
    row = np.repeat(np.arange(len(texts)), np.diff(ends))
    keys, n = np.unique(group[row] * size + codes, return_counts=True)
    once = distinct(row * size + codes)
    # The same keys in the same order, counted once per document.
    in_docs = np.unique(group[once // size] * size + once % size, return_counts=True)[1]
    which = keys // size
    take = lambda d, at: d.take(pa.array(at)).cast(pa.string())
    columns = [take(lang.dictionary, which // max(1, len(source.dictionary))), take(source.dictionary, which % max(1, len(source.dictionary))), take(terms, keys % size), pa.array(n.astype(np.int64)), pa.array(in_docs.astype(np.int64))]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "in_docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, in_docs): occurrences of each term in each group, and its documents that hold it.

    The matches of a block of some MB are counted where they are made, then the
    blocks' counts are summed.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", BLOCK_BYTES):
            yield _block_counts(block)

    rows = docs.select(_of("lang").alias("lang"), _of("source").alias("source"), F.col("text").cast("string").alias("text"))
    counts = rows.mapInArrow(count, "lang string, source string, term string, n bigint, in_docs bigint")
    return counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("in_docs").alias("in_docs"))


def divergences(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): the other sources of each group's language, and the terms that it has too many of."""
    spark = docs.sparkSession
    counts = materialize(spark, term_counts(docs), "term-counts")
    vocab = counts.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("in_docs").alias("in_docs")).where(F.col("in_docs") >= min_docs).drop("in_docs")
    vocab = materialize(spark, vocab, "vocabulary")
    kept = materialize(spark, counts.join(vocab, ["lang", "term"]).select("lang", "source", "term", "n"), "kept-counts")

    langs = vocab.groupBy("lang").agg(F.sum("n_lang").alias("all_lang"), F.count("*").alias("size"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("all_group"))
    groups = docs.select(_of("lang").alias("lang"), _of("source").alias("source")).distinct()
    groups = groups.join(langs, "lang", "left").join(sums, ["lang", "source"], "left")
    groups = materialize(spark, groups.select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("all_lang", "size", "all_group"))), "groups")

    salt = F.pmod(F.xxhash64("term"), F.lit(SALTS))
    spread = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    dense = spread.join(vocab.withColumn("salt", salt), ["lang", "salt"]).join(kept, ["lang", "source", "term"], "left")
    shares = dense.select("lang", "source", "term", F.coalesce("n", F.lit(0)).alias("n"), _share("n", "all_group", "size").alias("p"), _share("n_lang", "all_lang", "size").alias("q"))
    shares = materialize(spark, shares, "shares")

    ranked = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    # The divergence is symmetric: each pair is summed once and told from both sides.
    a, b = shares.select("lang", "term", "source", "p"), shares.select("lang", "term", F.col("source").alias("other"), F.col("p").alias("p_other"))
    sums = a.join(b, ["lang", "term"]).where("source < other").groupBy("lang", "source", "other").agg(F.sum(_apart("p", "p_other")).alias("value"))
    sums = sums.select("lang", "source", F.col("other").alias("item"), "value").unionByName(sums.select("lang", F.col("other").alias("source"), F.col("source").alias("item"), "value"))
    pairs = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source != item")
    pairs = pairs.join(sums, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(ranked))

    terms = shares.where("n > 0 and p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _apart("p", "q").cast("long").alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    return pairs.unionByName(terms)
