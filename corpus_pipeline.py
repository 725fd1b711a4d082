"""The corpus pipeline: five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet to the shared folder and gives it to the next stage.  All but the
last stage return the columns of documents, and any further ones that ``docs``
has, whatever their names and types.  An empty table stays empty in every stage;
a null text is a document without words; very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillscope.llm._common import fresh, materialize, scratch
from rillscope.llm.byte_bpe import bpe_digests
from rillscope.llm.decontamination import contaminated
from rillscope.llm.minhash_dedup import near_duplicates
from rillscope.llm.quality_rules import kept_documents
from rillscope.llm.substring_dedup import duplicate_passages, without_passages

TOKENIZER = "byte_bpe_50k.tiktoken"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; each row is judged by itself, also where its doc_id is null or occurs again."""
    return kept_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: the one with the least doc_id.

    Rows that share a doc_id are one document, of which the least row (by text)
    stays.  Rows without a doc_id cannot be named and stay.
    """
    classes = near_duplicates(docs)
    firsts = classes.where("doc_id = class_id").select("doc_id").distinct()
    # Maps have no order; their JSON does.
    rest = [F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in kind or kind == "variant" else F.col(f"`{c}`") for c, kind in docs.dtypes if c not in ("doc_id", "text")]
    named = docs.join(firsts.hint("merge"), "doc_id", "left_semi").select("doc_id", F.struct(docs.columns).alias("row_of_doc"), F.struct("text", *(r.alias(f"c{k}") for k, r in enumerate(rest))).alias("rank_of_row"))
    once = named.groupBy("doc_id").agg(F.min_by("row_of_doc", "rank_of_row").alias("row_of_doc")).select("row_of_doc.*")
    return once.unionByName(docs.where("doc_id is null"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that nearly occur in an earlier document are cut out; documents left empty by that go.  Rows without a doc_id stay as they are."""
    return without_passages(docs, duplicate_passages(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go; a row is named by its doc_id and a hash of its text, so it takes no other one with it."""
    hits = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    # Written first, so that its size is known when the join is planned.
    hit_id, hit_key = fresh(docs, "hit_id"), fresh(docs, "hit_key")
    hits = materialize(spark, hits.select(F.col("doc_id").alias(hit_id), F.col("text_key").alias(hit_key)).distinct(), "hits")
    return docs.join(hits, F.col("doc_id").eqNullSafe(F.col(hit_id)) & (F.xxhash64("text") == F.col(hit_key)), "left_anti")


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode what is left: doc_id, n_tokens, and digests of the ids and of the decoded bytes.

    One row for every row, also where doc_id is null or occurs again; a null
    text is encoded as the empty one.
    """
    import public_tokenizers

    return bpe_digests(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("minhash_dedup", minhash_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]

#: Signatures, Cartesian trees and merges are beyond SQL; tests hold the rows against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
