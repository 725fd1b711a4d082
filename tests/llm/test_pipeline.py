"""The corpus pipeline on the smallest table against brute force."""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from rillscope.llm.byte_bpe import encoding

from .test_dedup import classes, shingles, words
from .test_rules import features


def test_pipeline(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    columns = docs.columns
    rows = {r.doc_id: r.text for r in docs.collect()}
    # Too few labels for a learned cutoff here: only the base rules reject.
    want = {i: t for i, t in rows.items() if not features(t)[5]}
    for name, stage in corpus_pipeline.STAGES:
        path = f"{corpus_pipeline.scratch(spark, 'test')}"
        before = {r.doc_id: r.text for r in docs.collect()} if name != "byte_bpe" else None
        stage(spark, docs, small_dir).write.parquet(path)
        last, docs = docs, spark.read.parquet(path)
        if name != "byte_bpe":
            assert docs.columns == columns
            after = {r.doc_id: r.text for r in docs.collect()}
        if name == "quality_rules":
            assert after == want
        elif name == "minhash_dedup":
            of = classes(sorted(before.items()), True)
            assert after == {i: t for i, t in before.items() if of[i] == i}
        elif name == "substring_dedup":
            first: dict = {}
            for i, t in sorted(after.items()):
                w = words(t)
                for k in range(len(w) - 50):
                    g = tuple(w[k : k + 51])
                    assert first.setdefault(g, i) == i
            assert all(set(words(t)) <= set(words(before[i])) for i, t in after.items())
        elif name == "decontamination":
            bench = [r.text for r in spark.read.parquet(f"{small_dir}/benchmark.parquet").collect()]
            hit = {i for i, t in before.items() if any(b in t for b in bench)}
            assert hit <= set(before) - set(after)
            for i in set(before) - set(after) - hit:
                assert any(len(shingles(b) & shingles(before[i])) > 0.3 * len(shingles(b)) for b in bench)
    enc = encoding(public_tokenizers.path(corpus_pipeline.TOKENIZER), public_tokenizers.PATTERN)
    texts = {r.doc_id: r.text for r in last.collect()}
    got = {r.doc_id: (r.ids_sha256, r.decoded_sha256) for r in docs.collect()}
    assert got == {i: (hashlib.sha256(" ".join(map(str, enc.encode_ordinary(t))).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in texts.items()}


CLASHING = ("text_key", "hit_id", "hit_key", "span_id", "span_key", "span_list", "row", "row_of_doc", "class_id", "h", "id", "stratum", "block", "n_tokens", "c0")


def test_stages_take_odd_rows(spark, small_dir, odd_docs):
    """Null ids and texts, repeated rows, empty, blank and very long texts, and columns with the names that stages use inside."""
    long = " ".join(f"v{i}" for i in range(60_000))
    bench = spark.read.parquet(f"{small_dir}/benchmark.parquet").first().text
    more = [(40, f"start of it {bench} and its end"), (None, f"no id {bench}"), (41, long), (41, long), (42, long.replace("v77 ", "w77 "))]
    docs = odd_docs.unionByName(spark.createDataFrame([(i, t, "en", "s", len(t), 1, 2, "k") for i, t in more], odd_docs.schema))
    docs = docs.select("*", *(F.lit(f"x{c}").alias(c) for c in CLASHING), F.create_map(F.lit("a"), F.col("n")).alias("m"), F.array(F.lit(1.5)).alias("l"))
    rows = {(r.doc_id, r.text) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small_dir)
        assert stage(spark, docs.limit(0), small_dir).count() == 0
        if name == "byte_bpe":
            assert out.count() == docs.count()
            continue
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        kept = out.collect()
        assert all(r.span_id == "xspan_id" and r.m == {"a": 2} and r.l == [1.5] for r in kept)
        if name == "substring_dedup":
            assert {r.doc_id for r in kept} >= {-5, 4, 5, 9, 10, 12, 40, None}
            continue
        assert {(r.doc_id, r.text) for r in kept} <= rows
        ids = [r.doc_id for r in kept]
        if name == "quality_rules":
            assert 6 in ids and ids.count(41) == 2 and not {1, 2, 3, 4, 12} & set(ids)
        if name == "minhash_dedup":
            assert ids.count(41) == 1 and ids.count(8) <= 1 and not {7, 42} & set(ids) and ids.count(None) == 3
        if name == "decontamination":
            assert 40 not in ids and not any(t and bench in t for _, t in {(r.doc_id, r.text) for r in kept}) and len(kept) == docs.count() - 2


def test_registered(spark, small_dir):
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 14))
    out = __spark_entry__.queries()["op5_token_counts"](spark, small_dir)
    assert out.agg(F.sum("docs")).first()[0] == spark.read.parquet(f"{small_dir}/documents.parquet").count()
