"""Near-duplicate, passage and byte-string dedup against brute force."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillscope.llm import minhash_dedup, substring_dedup, suffix_dedup
from rillscope.llm.components import connected_components

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def shingles(text, counts=False):
    w = words(text)
    s = [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else ([tuple(w)] if w else [])
    return Counter(s) if counts else set(s)


def classes(rows, counts=False):
    """Class by (weighted) Jaccard similarity of 0.8 or equal text, for rows of different ids."""
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = {i: shingles(t, counts) for i, t in rows}
    for k, (i, s) in enumerate(rows):
        for j, t in rows[:k]:
            a, b = sets[i], sets[j]
            both = sum((a & b).values()) if counts else len(a & b)
            either = sum((a | b).values()) if counts else len(a | b)
            if s is not None and t is not None and (s == t or (either and both >= 0.8 * either)):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in rows}


def varied(make_docs, n=60, seed=1):
    """Documents with copies changed more and more, shared passages and plain ones."""
    rng = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(400)]
    base = [list(rng.choice(vocab, int(rng.integers(60, 200)))) for _ in range(8)]
    passage = list(rng.choice(vocab, 70))
    rows = []
    for i in range(n):
        w = list(base[i % 8])
        for _ in range(int(rng.integers(0, 9))):
            w[int(rng.integers(len(w)))] = str(rng.choice(vocab))
        if i % 5 == 0:
            w = list(rng.choice(vocab, 100)) + passage + list(rng.choice(vocab, 40))
        if i % 11 == 0:
            w = list(rng.choice(vocab, 120))
        rows.append((i, " ".join(w)))
    return rows, make_docs(rows)


@pytest.mark.parametrize("counts", [False, True])
def test_near_duplicates(make_docs, counts):
    rows, docs = varied(make_docs)
    got = {r.doc_id: r.class_id for r in minhash_dedup.near_duplicates(docs, counts=counts).collect()}
    assert got == classes(rows, counts)
    assert len(set(got.values())) < len(got)


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 2**63, 300, dtype=np.uint64)
    a, b = np.sort(ids[:220]), np.sort(ids[60:])
    wa, wb = rng.integers(1, 6, len(a)).astype(float), rng.integers(1, 6, len(b)).astype(float)
    s = minhash_dedup.dart_minhash(np.concatenate((a, b)), np.concatenate((wa, wb)), np.array([0, len(a), len(a) + len(b)]), 2000)
    da, db = dict(zip(a.tolist(), wa, strict=True)), dict(zip(b.tolist(), wb, strict=True))
    keys = set(da) | set(db)
    true = sum(min(da.get(k, 0), db.get(k, 0)) for k in keys) / sum(max(da.get(k, 0), db.get(k, 0)) for k in keys)
    assert abs((s[0] == s[1]).mean() - true) < 0.05


def test_near_duplicates_of_odd_rows(odd_docs, no_docs):
    out = minhash_dedup.near_duplicates(odd_docs).collect()
    assert len(out) == odd_docs.count()
    got = {(r.doc_id, r.class_id) for r in out}
    rows = list({r.doc_id: (r.doc_id, r.text) for r in odd_docs.where("doc_id is not null").collect()}.values())
    want = classes(sorted(rows), True)
    assert {g for g in got if g[0] is not None} == set(want.items())
    assert {g for g in got if g[0] is None} == {(None, None)}
    assert minhash_dedup.near_duplicates(no_docs).count() == 0


def test_pairs_across_components_are_told_apart(spark):
    """Of a bucket's many pairs at 0.7 to 0.8, those that share several buckets too, the join keeps once each and few but the links."""
    rng = np.random.default_rng(12)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for _ in range(150):
        words = list(base)
        for i in rng.choice(150, 2, replace=False):
            words[i] = f"x{rng.integers(1 << 30)}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id bigint, text string")
    sets = minhash_dedup.shingle_sets(docs, docs.select(F.col("doc_id").alias("id")), counts=True)
    grams = [{tuple(t.split()[i : i + 5]) for i in range(146)} for t in texts]
    alike = {(i + 1, j + 1): len(grams[i] & grams[j]) / len(grams[i] | grams[j]) for i in range(150) for j in range(i + 1, 150)}
    links = {p for p, s in alike.items() if s >= 0.8 and p[0] > 1}
    placed = spark.range(1, 151).select(F.explode(F.array(*(F.lit(k).cast("bigint") for k in (7, 8, 9)))).alias("key"), "id", F.lit(146).cast("bigint").alias("n"), F.lit(1).cast("bigint").alias("least"), F.col("id").alias("part"))
    found = {tuple(r) for r in minhash_dedup.cross_pairs(placed, sets, 0.8, True).collect()}
    assert links <= found
    near = sum(0.7 <= s < 0.8 for s in alike.values())
    assert near > 5000 and len(found - links) < near / 3


def test_parities_never_differ_more_than_the_sets():
    rng = np.random.default_rng(13)
    items = [np.unique(rng.integers(0, 400, k, dtype=np.uint64)) for k in (5, 80, 200, 300, 1000)]
    weights = [rng.integers(1, 4, len(i)).astype(np.float32) for i in items]
    odd = minhash_dedup.parities(items, weights)
    held = [dict(zip(i.tolist(), w.tolist(), strict=True)) for i, w in zip(items, weights, strict=True)]
    for x, p in zip(held, odd, strict=True):
        for y, q in zip(held, odd, strict=True):
            assert int((p != q).sum()) <= sum(abs(x.get(k, 0) - y.get(k, 0)) for k in x.keys() | y.keys())


def test_components(spark):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 80, (60, 2))] + [(i, i + 1) for i in range(100, 140)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in list(parent) if find(x) != x}


def test_compact_windows():
    rng = np.random.default_rng(4)
    for length in (2, 5, 9):
        sizes = rng.integers(0, 40, 5)
        ends = np.concatenate(([0], np.cumsum(sizes)))
        h = rng.integers(2**63, 2**64, ends[-1], dtype=np.uint64)
        got = set(zip(*(x.tolist() for x in substring_dedup.compact_windows(h, ends, length)), strict=True))
        want = set()
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            for c in range(a, b):
                lo = hi = c
                while lo > a and h[lo - 1] > h[c]:
                    lo -= 1
                while hi + 1 < b and h[hi + 1] > h[c]:
                    hi += 1
                if hi - lo + 1 >= length:
                    want.add((lo, c, hi))
        assert got == want


def test_passages(make_docs, no_docs, odd_docs):
    rows, docs = varied(make_docs)
    spans = substring_dedup.duplicate_passages(docs).collect()
    first, want = {}, set()
    for i, t in rows:
        w = words(t)
        runs = [tuple(w[k : k + 50]) for k in range(len(w) - 49)]
        if any(first.get(g, i) < i for g in runs):
            want.add(i)
        for g in runs:
            first.setdefault(g, i)
    assert want <= {s.doc_id for s in spans}
    text = dict(rows)
    for s in spans:
        assert s.source_id < s.doc_id and s.n_words >= 50
        mine = " ".join(words(text[s.doc_id])[s.first_word : s.first_word + s.n_words])
        a, b = shingles(mine), shingles(text[s.source_id])
        assert len(a & b) >= 0.85 * len(a)
    cut = substring_dedup.without_passages(docs, substring_dedup.duplicate_passages(docs))
    assert cut.columns == docs.columns
    left = {r.doc_id: r for r in cut.collect()}
    plain = {i for i, _ in rows} - {s.doc_id for s in spans}
    assert all(left[i].text == text[i] for i in plain)
    assert all(r.n_chars == len(r.text) for r in left.values())
    assert substring_dedup.duplicate_passages(no_docs).count() == 0
    odd = {(r.doc_id, r.source_id) for r in substring_dedup.duplicate_passages(odd_docs).collect()}
    assert {7, 8, 11} <= {d for d, _ in odd} and all(d is not None for d, _ in odd) and (8, 8) not in odd


def test_passage_whose_larger_part_is_older(make_docs):
    """Two documents share a passage of 60 words; 46 of them are also in an older, otherwise different document."""
    rng = np.random.default_rng(8)
    some = lambda n: [f"v{x}" for x in rng.integers(0, 10**6, n)]
    rows = []
    for i in range(16):
        p = some(60)
        rows += [(i, " ".join(some(40) + p[7:53] + some(40))), (100 + i, " ".join(some(50) + p + some(30))), (200 + i, " ".join(some(20) + p + some(60)))]
    got = {(s.doc_id, s.source_id) for s in substring_dedup.duplicate_passages(make_docs(rows)).collect()}
    assert {(200 + i, 100 + i) for i in range(16)} <= got


@pytest.mark.parametrize("size,older,part", [(50, 1, 44), (50, 2, 34), (50, 2, 44), (70, 2, 44), (60, 40, 20)])
def test_passage_whose_parts_are_older(make_docs, size, older, part):
    """Older documents hold parts of a passage, each too short to be one; the two that share all of it are found, changed words or not."""
    rng = np.random.default_rng(size + older + part)
    some = lambda n: [f"v{x}" for x in rng.integers(0, 10**6, n)]
    rows, want = [], set()
    for i in range(24):
        p = some(size)
        for k in range(older):
            at = int(rng.integers(size - part + 1))
            rows.append((10_000 + 100 * i + k, " ".join(some(40) + p[at : at + part] + some(40))))
        q = list(p)
        if i % 2:
            q[size // 2] = "changed"
        rows += [(20_000 + i, " ".join(some(50) + p + some(30))), (30_000 + i, " ".join(some(20) + q + some(60)))]
        want.add((30_000 + i, 20_000 + i))
    got = {(s.doc_id, s.source_id) for s in substring_dedup.duplicate_passages(make_docs(rows)).collect()}
    assert len(want & got) >= 0.95 * len(want)
    assert all(d >= 30_000 for d, _ in got)


def test_hot_phrase_and_versions(make_docs):
    """A frequent line makes no pairs; of many versions of a frequent passage each is found again, however many are older."""
    rng = np.random.default_rng(10)
    some = lambda n: [f"v{x}" for x in rng.integers(0, 10**6, n)]
    line, versions = some(25), [some(60) for _ in range(5)]
    rows = [(i, " ".join(some(40) + line + some(40))) for i in range(200)]
    rows += [(1000 + i, " ".join(some(40) + versions[i % 5] + some(10) + line)) for i in range(150)]
    out = substring_dedup.duplicate_passages(make_docs(rows)).collect()
    assert {s.doc_id for s in out} == set(range(1005, 1150))
    assert all((s.doc_id - s.source_id) % 5 == 0 for s in out)


def test_more_leaders_are_met_step_by_step():
    """Windows that a few more leaders settle must not meet 256 of them first."""
    assert [substring_dedup.more_leaders(16, n, 100) for n in (0, 100, 101, 10_000)] == [256, 256, 64, 64]


def test_word_hashes():
    """All words differ, wherever they stand and however long they are."""
    some = [b"a" * k for k in range(1, 80)] + [b"a" * k + b"\0" for k in range(40)] + ["naïve".encode(), "日本語".encode()]
    array = substring_dedup.pa.array(some, substring_dedup.pa.large_binary())
    h = substring_dedup.word_hashes(array)
    assert len(set(h.tolist())) == len(some)
    assert (substring_dedup.word_hashes(array.slice(7, 50)) == h[7:57]).all() and len(substring_dedup.word_hashes(array[:0])) == 0


def test_scattered_pieces_are_no_passage():
    rng = np.random.default_rng(11)
    pieces = [rng.integers(0, 2**63, 10, dtype=np.uint64) for _ in range(6)]
    other = lambda: rng.integers(0, 2**63, 200, dtype=np.uint64)
    scattered = np.concatenate([x for p in pieces for x in (other(), p)])
    assert substring_dedup.matching_spans(scattered, np.concatenate(pieces), 5, 50, 0.8) == []
    two = [rng.integers(0, 2**63, 60, dtype=np.uint64) for _ in range(2)]
    found = substring_dedup.matching_spans(np.concatenate((two[1], other(), two[0])), np.concatenate(two), 5, 50, 0.8)
    assert [f[:2] for f in found] == [(0, 60), (60, 60)]


def test_rows_that_share_a_doc_id_are_cut_apart(make_docs):
    rng = np.random.default_rng(12)
    some = lambda n: " ".join(f"v{x}" for x in rng.integers(0, 10**6, n))
    p, q = some(60), some(8)
    docs = make_docs([(1, f"{some(30)} {p}"), (2, f"{some(100)} {p}"), (2, q), (2, None), (3, p), (None, p)])
    cut = substring_dedup.without_passages(docs, substring_dedup.duplicate_passages(docs))
    left = sorted((str(r.doc_id), r.text or "") for r in cut.collect())
    assert [x[0] for x in left] == ["1", "2", "2", "2", "None"] and ("2", q) in left and ("2", "") in left
    assert sum(p in x[1] for x in left) == 2


def test_spans_reach_over_a_changed_word_near_an_end():
    rng = np.random.default_rng(9)
    earlier = rng.integers(0, 2**63, 46, dtype=np.uint64)
    for word in (2, 47):
        later = earlier.copy()
        gone = slice(max(0, word - 4), min(46, word + 1))
        later[gone] = rng.integers(0, 2**63, gone.stop - gone.start, dtype=np.uint64)
        assert [s[:2] for s in substring_dedup.matching_spans(earlier, later, 5, 50, 0.8)] == [(0, 46)]
    assert substring_dedup.matching_spans(earlier, np.concatenate((later[:40], later[:4])), 5, 50, 0.8) == []


def brute_bytes(rows):
    first = {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        x = (t or "").encode()
        for k in range(len(x) - 49):
            first.setdefault(x[k : k + 50], i)
    out = []
    for i, t in rows:
        x = (t or "").encode()
        gone = np.zeros(len(x), bool)
        for k in range(len(x) - 49 if i is not None else 0):
            if first[x[k : k + 50]] < i:
                gone[k : k + 50] = True
        spans = int(np.count_nonzero(np.diff(np.concatenate(([0], gone.view(np.int8)))) == 1))
        out.append((str(i), len(x), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(x, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out)


def test_repeated_bytes(make_docs, odd_docs, no_docs):
    rng = np.random.default_rng(5)
    rows, _ = varied(make_docs, 40)
    rows += [(100, "ab" * 60), (101, "x" + "ab" * 70), (102, "a" * 49), (103, "a" * 50), (104, "a" * 51), (105, "".join(rng.choice(list("ab"), 400)))]
    for docs in (make_docs(rows), odd_docs):
        got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.repeated_bytes(docs).collect())
        assert got == brute_bytes([(r.doc_id, r.text) for r in docs.collect()])
    assert suffix_dedup.repeated_bytes(no_docs).count() == 0


def test_merged_transform_is_sorted():
    rng = np.random.default_rng(6)
    rows = np.zeros((37, suffix_dedup.PADDED), np.uint8)
    rows[:, : suffix_dedup.WIDTH] = rng.integers(97, 99, (37, suffix_dedup.WIDTH))
    owners = np.arange(37)[::-1].copy()
    shard = rng.integers(0, 5, 37)
    got = suffix_dedup.repeated(rows, np.full(37, suffix_dedup.WIDTH), owners, shard)
    least = {}
    for i in range(37):
        for k in range(suffix_dedup.STARTS):
            s = rows[i, k : k + 50].tobytes()
            least[s] = min(least.get(s, 99), owners[i])
    assert all(got[i, k] == least[rows[i, k : k + 50].tobytes()] for i in range(37) for k in range(suffix_dedup.STARTS))


def test_common_prefixes():
    rng = np.random.default_rng(14)
    rows = np.zeros((20, suffix_dedup.PADDED), np.uint8)
    rows[:, : suffix_dedup.WIDTH] = rng.integers(97, 99, (20, suffix_dedup.WIDTH))
    rows[10:15] = rows[:5]
    symbols = suffix_dedup.words_at(np.pad(rows, ((0, 0), (0, 8))).reshape(-1)).reshape(20, -1)[:, : suffix_dedup.PADDED]
    ranks, short = suffix_dedup._ranked(symbols[:, : suffix_dedup.WIDTH - 7]), suffix_dedup._ranked(symbols >> suffix_dedup.SHORT)
    t = suffix_dedup.Transforms(ranks, short, np.repeat(np.arange(4), 5))
    z, lcp = suffix_dedup.merge(t)
    at = {k: iter(np.flatnonzero(t.shard == k)) for k in range(4)}
    strings = [rows[t.row[i], t.start[i] : t.start[i] + 50].tobytes() for i in (next(at[k]) for k in z)]
    assert strings == sorted(strings)
    for x, y, n in zip(strings, strings[1:], lcp[1:], strict=False):
        true = next((k for k in range(50) if x[k] != y[k]), 50)
        assert n == (50 if true == 50 else true // 8 * 8)


def test_hot_groups(make_docs):
    """One class of many near copies stays one class and links stay linear."""
    rng = np.random.default_rng(7)
    base = [f"h{i}" for i in range(150)]
    rows = []
    for i in range(300):
        w = list(base)
        w[int(rng.integers(150))] = f"z{i % 40}"
        rows.append((i, " ".join(w)))
    out = minhash_dedup.near_duplicates(make_docs(rows)).agg(F.countDistinct("class_id"), F.sum("n_spanning")).first()
    assert out[0] == 1 and out[1] < 20 * 300


def test_hot_gram_of_many_shards():
    """One gram with so many contexts from so many blocks that shard and symbol do not fit in 32 bits together."""
    rng = np.random.default_rng(8)
    n, shards = 30_000, 3_000
    rows = np.zeros((n, suffix_dedup.PADDED), np.uint8)
    rows[:, : suffix_dedup.WIDTH] = rng.integers(0, 256, (n, suffix_dedup.WIDTH))
    rows[:, suffix_dedup.BEFORE : suffix_dedup.BEFORE + suffix_dedup.GRAM] = ord("-")
    rows[n // 2 :, suffix_dedup.BEFORE :] = rows[: n - n // 2, suffix_dedup.BEFORE :]  # what follows the gram occurs twice
    owners, shard = rng.permutation(n).astype(np.int64), rng.integers(0, shards, n)
    got = suffix_dedup.repeated(rows, np.full(n, suffix_dedup.WIDTH), owners, shard)
    least: dict = {}
    strings = [[r[s : s + suffix_dedup.LENGTH] for s in range(suffix_dedup.STARTS)] for r in (x.tobytes() for x in rows)]
    for parts, owner in zip(strings, owners.tolist(), strict=True):
        for p in parts:
            least[p] = min(owner, least.get(p, owner))
    assert got.tolist() == [[least[p] for p in parts] for parts in strings]


def test_more_owners_than_16_bits():
    n = 70_000
    keys = np.concatenate((np.full(n, 6, np.uint64), np.full(3, 9, np.uint64)))
    texts = np.concatenate((np.arange(n), np.arange(3)))
    asks = substring_dedup._ask_owners(0, 1, 1 << 20, keys, texts, np.zeros((5, len(keys)), np.int64), np.arange(n, dtype=np.int64) * 3)
    table = substring_dedup.pa.Table.from_pylist([r for r in asks if r["kind"] == substring_dedup.ASK], schema=substring_dedup.ARROW)
    (answer,) = substring_dedup._rows(substring_dedup._answer_owners(table, 1 << 20, 65_536))
    assert substring_dedup.unpack(answer["a"], 2, np.int64).tolist() == [n, 3]
    sent = substring_dedup.unpack(answer["b"], answer["m"], np.int64)
    assert sent[:n].tolist() == list(range(0, 3 * n, 3)) and sent[n:].tolist() == [0, 3, 6]
