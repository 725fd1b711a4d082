r"""Exact dedup: group by a 128-bit content hash, keep the smallest id, compare bytes inside groups.

Two texts are equal when they are identical after every run of
``[\x20\x09-\x0D]`` is replaced by one space.

1. Digests of all rows (some 60 bytes each) are written once, with a number
   that tells rows apart.  They are grouped by hash with map-side combine, so a
   group that holds a third of all rows is one small row per task.
2. Rows whose hash occurs again are compared byte by byte: an aggregation keyed
   by (hash, text).  Texts that nothing shares a hash with stay where they are:
   a bitmap of the repeated hashes, of at most 2^MARK_BITS bits, picks the texts
   that travel.  The bitmap may let others through, never fewer.
3. Where one hash stands for different texts (a collision), those rows are
   grouped by hash and text instead.
4. Members find their group by a join on the hash.  Groups above 1/HOT of all
   rows, of which there are fewer than HOT, are broadcast, so no key of the
   shuffled join is hot.

Defined cases: a null text counts as empty; a null id sorts last, and the group
of null ids only has a null ``keep_id``; of rows that share id and text exactly
one stays; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialize

#: Bits of the bitmap of repeated hashes: 2^27 bits are 4,096 rows of 4 KB, 16 MB.
MARK_BITS = 27
#: Groups of more than 1/HOT of all rows are joined by broadcast.
HOT = 4096


def normalized(text: str) -> Column:
    r"""A text with each run of ``[\x20\x09-\x0D]`` replaced by one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def content_hash(norm: Column) -> Column:
    """128 bits of a text."""
    return F.unhex(F.md5(norm))


def _mark(h: str) -> Column:
    """A hash's place in the bitmap."""
    return F.xxhash64(h).bitwiseAND(F.lit((1 << MARK_BITS) - 1))


def _marked(texts: DataFrame, repeated: DataFrame) -> DataFrame:
    """The rows whose hash may be among the repeated ones; one broadcast of at most 2^MARK_BITS bits."""
    bits = repeated.select(_mark("h").alias("m")).groupBy(F.bitmap_bucket_number("m").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("m")).alias("bits"))
    keyed = texts.withColumn("m", _mark("h")).withColumn("bucket", F.bitmap_bucket_number("m")).withColumn("at", F.bitmap_bit_position("m"))
    byte = F.conv(F.hex(F.substring("bits", (F.col("at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    set_ = F.expr("shiftright(byte, cast(at % 8 as int)) & 1") == 1
    return keyed.join(F.broadcast(bits), "bucket").withColumn("byte", byte).where(set_).select(texts.columns)


def _groups(rows: DataFrame, *keys: str) -> DataFrame:
    """The first row and the size of each group; a null id is after all others."""
    least = F.struct(F.col("id").isNull().alias("no_id"), "id", "row")
    return rows.groupBy(*keys).agg(F.min(least).alias("least"), F.count("*").alias("group_size"))


def _joined(rows: DataFrame, groups: DataFrame, total: int, *keys: str) -> DataFrame:
    """Rows with their group; a row without one is alone."""
    is_hot = F.col("group_size") > max(1000, total // HOT)
    hot, cold = groups.where(is_hot), groups.where(~is_hot)
    few = F.broadcast(hot)
    return rows.join(few, list(keys)).unionByName(rows.join(few, list(keys), "left_anti").join(cold, list(keys), "left"))


def exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", hashed=content_hash) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) of every row of ``docs``, dropped ones too."""
    spark = docs.sparkSession
    plain = docs.select(F.col(id_column).alias("id"), normalized(text_column).alias("norm"))
    texts = plain.withColumn("h", hashed(F.col("norm")))
    digests = materialize(spark, texts.select("id", F.monotonically_increasing_id().alias("row"), "h", F.unhex(F.sha2("norm", 256)).alias("sha")), "digests")
    repeated = materialize(spark, _groups(digests, "h").where("group_size > 1"), "repeated")

    compared = _marked(texts.select("h", "norm"), repeated.select("h")).groupBy("h", "norm").agg(F.count("*").alias("n")).select("h")
    collided = materialize(spark, compared.groupBy("h").agg(F.count("*").alias("texts")).where("texts > 1").select("h"), "collided")
    total = digests.count()
    if collided.isEmpty():
        out = _joined(digests, repeated, total, "h")
    else:
        # Texts under such a hash are few: no two are known for the hash in use.
        own = materialize(spark, texts.join(collided, "h", "left_semi").select("id", F.monotonically_increasing_id().alias("row"), "h", "norm", F.unhex(F.sha2("norm", 256)).alias("sha")), "collided-rows")
        apart = _joined(own, _groups(own, "h", "norm"), total, "h", "norm").drop("norm")
        out = _joined(digests.join(collided, "h", "left_anti"), repeated.join(collided, "h", "left_anti"), total, "h").unionByName(apart)
    first = F.coalesce(F.col("least.row") == F.col("row"), F.lit(True))
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("least.id"))
    return out.select(F.col("id").alias(id_column), keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), first.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def without_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    A row is named by its id and the digest of its text; rows that share both
    are told apart no further, and any one of them stays.
    """
    kept = exact_duplicates(docs, id_column, text_column).where("kept").select(F.struct(F.col(id_column).alias("id"), F.col("text_sha256").alias("sha")).alias("kept_name"))
    name = F.struct(F.col(id_column).alias("id"), F.sha2(normalized(text_column), 256).alias("sha"))
    rows = docs.select(F.struct(*docs.columns).alias("kept_row"), name.alias("kept_key"))
    found = rows.join(kept, F.col("kept_key").eqNullSafe(F.col("kept_name")), "left_semi")
    return found.dropDuplicates(["kept_key"]).select("kept_row.*")
