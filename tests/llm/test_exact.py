"""Exact dedup, whitening and source divergence against brute force and SQL."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rillscope.llm import oracle, queries
from rillscope.llm.divergence import divergences
from rillscope.llm.exact_dedup import exact_duplicates, without_duplicates
from rillscope.llm.whitening import Welford, moments, symmetric_qr, whiten


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def equal_groups(rows):
    """What the docstring of the operator says, by a dictionary of texts."""
    by = defaultdict(list)
    for i, t in rows:
        by[norm(t)].append(i)
    out = []
    for t, ids in by.items():
        ids = sorted(ids, key=lambda i: (i is None, i))
        out += [(i, ids[0], len(ids), k == 0, hashlib.sha256(t.encode()).hexdigest()) for k, i in enumerate(ids)]
    return sorted(out, key=repr)


def deduped(docs, **more):
    return sorted((tuple(r) for r in exact_duplicates(docs, **more).collect()), key=repr)


@pytest.mark.parametrize("bits", [16, 2, 0])
def test_exact_dedup(odd_docs, bits):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    want = equal_groups(rows)
    assert deduped(odd_docs) == want
    # Hashes that stand for many texts: only the comparison of bytes tells them apart.
    assert deduped(odd_docs, hashed=lambda n: F.unhex(F.substring(F.md5(n), 1, bits))) == want


def test_exact_dedup_hot_group(spark):
    docs = spark.range(9000).select((F.col("id") * 7 % 9001).alias("doc_id"), F.when(F.col("id") % 3 == 0, "the\tsame  text").otherwise(F.concat(F.lit("t "), F.col("id"))).alias("text"), F.lit("x").alias("h"), F.lit(1).alias("row"))
    got = exact_duplicates(docs)
    assert got.where("kept").count() == 6001
    assert [tuple(r) for r in got.where("group_size > 1").select("keep_id", "group_size").distinct().collect()] == [(0, 3000)]
    stay = without_duplicates(docs)
    assert stay.columns == docs.columns and stay.count() == 6001


def test_exact_dedup_empty(no_docs, odd_docs):
    assert exact_duplicates(no_docs).count() == 0
    assert without_duplicates(odd_docs).count() == len({norm(r.text) for r in odd_docs.collect()})


def test_symmetric_qr():
    rng = np.random.default_rng(1)
    for d in (1, 2, 3, 30):
        a = rng.normal(size=(d + 3, d))
        for c in (a.T @ a, np.diag(np.arange(d, dtype=float)), np.zeros((d, d)), np.ones((d, d))):
            values, q = symmetric_qr(c)
            scale = max(1.0, np.abs(c).max() * d)
            assert np.allclose(values, np.linalg.eigvalsh(c)[::-1], atol=1e-13 * scale, rtol=0)
            assert np.allclose(q @ q.T, np.eye(d), atol=1e-13)
            assert np.allclose(q @ c @ q.T, np.diag(values), atol=1e-13 * scale)


def test_welford_parts(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(-500, 500, (700, 5)) + 10**6
    whole = Welford(5)
    whole.add(x)
    df = spark.createDataFrame([(r.tolist(),) for r in x], "x array<bigint>").repartition(70)
    parts = moments(df, "x", 5)  # more tasks than meet in one round
    for w in (whole, parts):
        assert (w.n, w.sums) == (700, x.sum(axis=0).tolist())
        assert np.allclose(w.covariance(), np.cov(x.T, bias=True), rtol=1e-12, atol=1e-7)


def whitened_by_numpy(rows):
    good = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array(sorted({tuple(v) for _, v in good}))
    n, s = len(x), x.sum(axis=0)
    values, q = np.linalg.eigh(np.cov(x.T, bias=True))
    out = {}
    for i, v in good:
        for k in range(min(4, len(values))):
            e = values[-1 - k]
            out[i, k + 1] = (n, int(((n * v - s) ** 2).sum()), abs(float((v - s / n) @ q[:, -1 - k])) / np.sqrt(e), e / values.sum())
    return out


def test_whitening(spark, small_dir):
    found = queries.queries()["op12_whitening"](spark, small_dir).collect()
    want = whitened_by_numpy([(r.vec_id, r.embedding) for r in spark.read.parquet(f"{small_dir}/embeddings.parquet").collect()])
    assert {(r.vec_id, r.component) for r in found} == set(want)
    for r in found:
        n, deviation, size, share = want[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, deviation)
        assert abs(r.whitened) == pytest.approx(size, abs=1e-9) and r.explained == pytest.approx(share, rel=1e-9) and r.identity_error < 1e-9


def test_whitening_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 3)).astype(np.float32).tolist()
    rows = [(i, v) for i, v in enumerate(base)] + [(100, base[0]), (0, base[0]), (101, None), (102, [1.0, None, 2.0]), (103, [nan, 0.0, 0.0]), (104, [0.0, -inf, 0.0]), (105, [1.0, 2.0]), (106, []), (None, base[1])]
    df = spark.createDataFrame([(i, v, 5, 1.5) for i, v in rows], "vec_id bigint, embedding array<float>, n int, component double")
    found = whiten(df).collect()
    want = whitened_by_numpy([r for r in rows if r[1] is None or len(r[1]) == 3])
    assert Counter((r.vec_id, r.component) for r in found) == Counter((i, k) for i in [*range(40), 100, 0, None] for k in (1, 2, 3))
    for r in found:
        assert (r.n, r.deviation) == want[r.vec_id, r.component][:2] and abs(r.whitened) == pytest.approx(want[r.vec_id, r.component][2], abs=1e-9)


def test_whitening_without_variance(spark):
    schema = "vec_id bigint, embedding array<double>"
    assert whiten(spark.createDataFrame([], schema)).count() == 0
    one = whiten(spark.createDataFrame([(1, [0.5, 0.25]), (2, [0.5, 0.25])], schema)).collect()
    assert len(one) == 4 and all(r.n == 1 and r.deviation == 0 and r.whitened is None and r.explained is None and r.identity_error is None for r in one)
    line = whiten(spark.createDataFrame([(i, [i / 256, 3.0]) for i in range(4)], schema)).collect()
    assert {r.component: r.explained for r in line} == {1: 1.0, 2: 0.0} and all((r.whitened is None) == (r.component == 2) for r in line)
    large = whiten(spark.createDataFrame([(i, [i * 1e17, 3.0]) for i in range(3)], schema)).collect()
    assert all(r.deviation is None for r in large if r.vec_id != 1)


def audit(rows, min_docs):
    """Dictionaries and loops for the relations of the operator."""
    terms = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    held, counts, groups = defaultdict(set), defaultdict(Counter), set()
    for k, (lang, source, text) in enumerate(rows):
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        for t in terms(text):
            held[lang, t].add(k)
            counts[lang, source][t] += 1
            counts[lang, None][t] += 1
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for (la, t), docs in held.items() if la == lang and len(docs) >= min_docs]

        def shares(source, lang=lang, kept=kept):
            c = counts[lang, source]
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        apart = lambda p, q: (p - q) ** 2 // (p + q)
        q = shares(None)
        for source in sorted(s for la, s in groups if la == lang):
            p = shares(source)
            pairs = [("pair", s, sum(apart(p[t], r[t]) for t in kept)) for s in (s for la, s in groups if la == lang and s != source) for r in [shares(s)]]
            over = [("term", t, apart(p[t], q[t])) for t in kept if counts[lang, source][t] and p[t] > q[t]]
            for part, most in ((pairs, None), (over, 10)):
                part.sort(key=lambda x: (-x[2], x[1].encode()))
                out += [(lang, source, *x, k + 1) for k, x in enumerate(part[:most])]
    return sorted(out)


def test_divergence(spark):
    rng = np.random.default_rng(4)
    words = ["Über", "übER", "a", "B", "日本", "don't", "e9e", "İ", "É", "zz"]
    rows = [(lang, source, " ".join(rng.choice(words, 30 if source else 3))) for lang in ("en", "de", None) for source in ("s1", "s2", None, "Ω") for _ in range(3)]
    rows += [("fr", "only", "mot " * 50), ("en", "empty", None), ("xx", "s1", "rare"), ("xx", "s2", ""), ("", "s1", "b " * 5000)]
    docs = spark.createDataFrame([(k, *r, "t", 1) for k, r in enumerate(rows)], "doc_id int, lang string, source string, text string, term string, n int").repartition(3)
    for least in (3, 1):
        assert sorted(tuple(r) for r in divergences(docs, least).collect()) == audit(rows, least)
    assert divergences(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op11_exact_dedup", "op13_source_divergence"])
def test_same_as_sql(spark, small_dir, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small_dir}/documents.parquet'")
    want = con.execute({"op11_exact_dedup": oracle.exact_dedup_sql, "op13_source_divergence": oracle.divergence_sql}[name]()).df()
    got = queries.queries()[name](spark, small_dir).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    plain = lambda df: sorted(map(repr, df[sorted(df.columns)].astype(object).itertuples(index=False, name=None)))
    assert plain(got) == plain(want)
