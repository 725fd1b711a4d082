"""Quality rules, decontamination, chat repair and language-model scores against brute force."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillscope.llm import chat_format, decontamination, lm_scoring, quality_rules
from rillscope.llm.elias_fano import EliasFano, Trie

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def features(text):
    x = text or ""
    w = [y for y in SPACE.split(x) if y]
    runs = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    often, covered = Counter(runs), set()
    for k, g in enumerate(runs):
        if often[g] > 1:
            covered.update(range(k, k + 8))
    lines = [y for y in x.split("\n") if re.search(r"[^\x20\x09-\x0D]", y)]
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_features(odd_docs, make_docs, no_docs):
    more = make_docs([(1, "a b c d e f g h " * 3), (2, "l1\nl1\n \nl1 \nl2"), (3, " lead trail \x0b\x0c"), (4, "p q r s t u v w x p q r s t u v w"), (5, "#*$ %&|<>")])
    for docs in (odd_docs, more):
        got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.text_features(docs).collect())
        assert got == sorted((str(r.doc_id), *features(r.text)) for r in docs.collect())
    assert quality_rules.text_features(no_docs).count() == 0


def test_binomial_tail(spark):
    cases = [(10, 0, 0.1), (10, 3, 0.1), (50, 50, 0.2), (2000, 15, 0.01)]
    for n, k, p in cases:
        got = spark.range(1).select(quality_rules.binomial_tail(F.lit(n), F.lit(k), p)).first()[0]
        want = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p)) for i in range(k + 1))
        assert got == pytest.approx(want, rel=1e-6)


def test_thresholds_are_safe(spark, make_docs):
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(1500):
        bad = i % 5 == 0
        w = [f"w{x}" for x in rng.integers(0, 5000, 30)]
        if bad:
            w = [x + "!!" for x in w]
        rows.append((i, " ".join(w)))
        labels.append((i, 0 if bad else 1))
    docs = make_docs(rows)
    table = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id bigint, quality int")
    out = quality_rules.quality_verdicts(docs, table).toPandas().set_index("doc_id")
    bad = out.index % 5 == 0
    assert not out[bad].kept.any() and out[~bad].kept.mean() > 0.95
    # With few labels nothing can be shown to be safe, so only the base rules reject.
    few = quality_rules.quality_verdicts(docs, table.where("doc_id < 40"))
    assert few.where("kept = base_failed").count() == 0
    assert quality_rules.quality_verdicts(docs, table.limit(0)).where("not kept").count() == 0


def test_verdicts_run_no_python(odd_docs, spark):
    labels = spark.createDataFrame([(6, 1)], "doc_id bigint, quality int")
    plan = quality_rules.text_features(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    out = quality_rules.quality_verdicts(odd_docs, labels).collect()
    assert len(out) == odd_docs.count() and not next(r for r in out if r.doc_id == 1).kept


def test_decontamination(spark, make_docs, no_docs):
    rng = np.random.default_rng(2)
    vocab = [f"t{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choice(vocab, int(rng.integers(12, 60)))).capitalize() + ".") for i in range(90)]
    bench = spark.createDataFrame([*items, (None, None), (900, ""), (901, "too short, that!")], "item_id bigint, text string")
    rows, want = [], set()
    for i in range(120):
        w = list(rng.choice(vocab, 300))
        if i % 3 == 0:
            k = int(rng.integers(90))
            at = int(rng.integers(300))
            w[at:at] = items[k][1].split()
            want.add((i, k))
        rows.append((i, " ".join(w)))
    rows += [(500, items[5][1]), (501, None), (None, items[6][1]), (502, items[7][1].upper()), (502, "another text"), (503, "x Too short that y"), (504, "too y short that"), (505, items[8][1] + " " + "z " * 20_000), (500, items[5][1])]
    want |= {(500, 5), (None, 6), (502, 7), (503, 901), (505, 8)}
    # One word changed in the last third of an item.
    w = items[9][1].split()
    rows.append((506, " ".join([*w[:-2], "changed", w[-1]])))
    want.add((506, 9))
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(make_docs(rows), bench).collect()}
    assert got == want
    assert sum(r.doc_id == 500 for r in decontamination.contaminated(make_docs(rows), bench).collect()) == 2  # repeated rows are searched each
    assert decontamination.contaminated(no_docs, bench).count() == 0
    assert decontamination.contaminated(make_docs(rows[:3]), bench.limit(0)).count() == 0


def test_block_max_search_is_exhaustive():
    rng = np.random.default_rng(3)
    rows = [(i, [f"t{x}" for x in rng.zipf(1.4, 20) % 200], [f"t{x}" for x in rng.zipf(1.4, 8) % 200]) for i in range(70)]
    df = Counter(t for _, q, a in rows for t in set(q + a))
    shard = decontamination.build_shard(rows, df, len(rows), 28.0)
    terms = np.array([shard.terms.get(f"t{x}", -1) for x in rng.zipf(1.4, 3000) % 220])
    offsets = np.array([0, 700, 700, 705, 3000])
    for threshold in (0.3, 0.5):
        got = {(t, s, i): v for t, s, _, i, v in decontamination.search(terms, offsets, shard, threshold)}
        want = {}
        for t, s, n in zip(*decontamination.passages(offsets, shard.width), strict=True):
            have = set(terms[s : s + n].tolist()) - {-1}
            for i in range(len(rows)):
                v = sum(w for k in have for p, w in zip(shard.items[shard.first[k] : shard.first[k + 1]], shard.impacts[shard.first[k] : shard.first[k + 1]], strict=True) if p == i)
                if v >= threshold:
                    want[int(t), int(s), i] = v
        assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-5) for k in got)


def best_cost(states):
    costs = {chat_format.START: 0}

    def closed(c):
        c = dict(c)
        for _ in range(5):
            for s, v in list(c.items()):
                for t in chat_format.NEXT[s]:
                    c[t] = min(c.get(t, 1 << 30), v + chat_format.COSTS["insert"])
        return c

    for state in states:
        now: dict = {}
        for f, t, cost, _ in chat_format.EDITS[state]:
            if f in closed(costs):
                now[t] = min(now.get(t, 1 << 30), closed(costs)[f] + cost)
        costs = now
    return closed(costs)[chat_format.ASSISTANT]


def check_chats(spark, rows):
    conv = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, position string, kind int")
    out = chat_format.repaired_turns(conv).collect()
    by: dict = {}
    for r in out:
        by.setdefault(r.conv_id, []).append(r)
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")
    assert set(by) == {r[0] for r in rows}
    for c, turns in by.items():
        mine = sorted((r for r in rows if r[0] == c), key=key)
        turns.sort(key=lambda r: (r.position, r.sub))
        assert len({(r.position, r.sub) for r in turns}) == len(turns)
        assert sum(r.cost for r in turns) == best_cost([chat_format.role_state(r[2]) for r in mine])
        state = chat_format.START
        for r in turns:
            if r.edit != "merge":
                assert chat_format.role_state(r.role) in chat_format.NEXT[state]
                state = chat_format.role_state(r.role)
        assert state == chat_format.ASSISTANT
        assert [r.text for r in turns if r.edit != "insert"] == [m[3] or "" for m in mine]
        text = "".join(r.rendered for r in turns)
        assert text.endswith("<|end|>\n") and text.count("<|end|>") == sum(r.edit != "merge" for r in turns)


def test_chat_repair(spark, monkeypatch):
    rng = np.random.default_rng(4)
    roles = ["system", "user", "assistant", "User ", None, "tool", "assistant", "user"]
    rows = []
    for c in range(40):
        for t in range(int(rng.integers(1, 9))):
            rows.append((c, t, roles[int(rng.integers(8))], f"m{t}", "x", 1))
    rows += [(None, 0, "assistant", None, None, None), (77, None, "user", "n", None, None), (77, 0, "user", "a", None, None), (77, 0, "user", "a", None, None)]
    check_chats(spark, rows)
    # A long conversation goes through several segments and groups of segments.
    monkeypatch.setattr(chat_format, "SEGMENT", 4)
    monkeypatch.setattr(chat_format, "GROUP", 3)
    rows += [(99, t, roles[int(rng.integers(8))], f"h{t}", "x", 1) for t in range(150)]
    check_chats(spark, rows)
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat_format.repaired_turns(empty).count() == 0


def test_elias_fano():
    rng = np.random.default_rng(5)
    for n, top in ((0, 9), (1, 4), (900, 10**13), (4000, 4001), (3000, 70)):
        v = np.sort(rng.integers(0, top, n))
        e = EliasFano.build(v, top)
        i = rng.integers(0, max(n, 1), 300) if n else np.zeros(0, np.int64)
        assert (e.get(i) == v[i]).all()
        want = np.concatenate((v[i], rng.integers(0, top, 300)))
        place = e.find(want)
        assert ((place >= 0) == np.isin(want, v)).all() and (v[place[place >= 0]] == want[place >= 0]).all()


def test_trie():
    rng = np.random.default_rng(7)
    grams = rng.zipf(1.3, (5000, 3)).astype(np.uint64) % np.uint64(300)
    low, bits = np.uint64(0xFFFFFFFF), np.uint64(32)
    pairs, which = np.unique(grams[:, 0] << bits | grams[:, 1], return_inverse=True)
    triples, count = np.unique(which.astype(np.uint64) << bits | grams[:, 2], return_counts=True)
    total = np.bincount(grams[:, 0].astype(np.int64), minlength=300)[(pairs >> bits).astype(np.int64)]
    trie = Trie.load(lm_scoring.build_trie(pairs, np.bincount(which), total, triples, count, 512).dump())
    place = trie.find_pairs(pairs >> bits, pairs & low)
    assert (place == np.arange(len(pairs))).all()
    assert (trie.find_triples((triples >> bits).astype(np.int64), triples & low) == np.arange(len(triples))).all()
    asked = rng.integers(0, 310, (3000, 3)).astype(np.uint64)
    place = trie.find_pairs(asked[:, 0], asked[:, 1])
    has = np.isin(asked[:, 0] << bits | asked[:, 1], pairs)
    assert ((place >= 0) == has).all()
    assert ((trie.find_triples(place, asked[:, 2]) >= 0) == (has & np.isin(np.maximum(place, 0).astype(np.uint64) << bits | asked[:, 2], triples))).all()
    back = lm_scoring.dequantise(trie.values[1]) * (total[(triples >> bits).astype(np.int64)] + lm_scoring.MU)
    assert (np.rint(back) == count)[count < lm_scoring.EXACT].all()


def test_lm_scores(odd_docs, no_docs, make_docs):
    rng = np.random.default_rng(6)
    docs = make_docs([(i, " ".join(f"W{x}" for x in rng.zipf(1.5, 60) % 50)) for i in range(60)]).unionByName(odd_docs)
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    data = [(r.doc_id, ["<", "<", *[w for w in SPACE.split((r.text or "").translate(lower)) if w], ">"]) for r in docs.collect()]
    c1, c2, c3, h1, h2 = (Counter() for _ in range(5))
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    for i, w in data:
        if not held(i):
            for a, b, c in zip(w, w[1:], w[2:], strict=False):
                c1[c] += 1
                c2[b, c] += 1
                c3[a, b, c] += 1
                h1[b] += 1
                h2[a, b] += 1
    total, types = sum(c1.values()), len(c1)
    want = []
    for i, w in data:
        base = score = known = 0
        for k, (a, b, c) in enumerate(zip(w, w[1:], w[2:], strict=False)):
            p = (c1[c] + 1) / (total + types + 1)
            base += math.log10(p)
            known += c1[c] > 0
            p = (c2[b, c] + lm_scoring.MU * p) / (h1[b] + lm_scoring.MU)
            score += math.log10((c3[a, b, c] + lm_scoring.MU * p) / (h2[a, b] + lm_scoring.MU) if k else p)  # the first word has one begin token as its history
        want.append((str(i), held(i), len(w) - 2, known, base, score))
    # Frequent words are dealt by two and three words; small blocks ask each on their own.
    for out in (lm_scoring.score_texts(docs), lm_scoring.score_texts(docs, hot=3, block_bytes=3000)):
        got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.base_score, r.score) for r in out.collect())
        for g, w in zip(got, sorted(want), strict=True):
            assert g[:4] == w[:4] and g[4] == pytest.approx(w[4], rel=1e-9) and abs(g[5] - w[5]) <= g[2] * lm_scoring.STEP  # quantised logarithms
    assert lm_scoring.score_texts(no_docs).count() == 0


def test_lm_context_of_many_successors(make_docs):
    """Words that never follow a context get no share of it, however many others do."""
    held = next(i for i in range(99) if lm_scoring.is_held_out(i))
    train = next(i for i in range(99) if not lm_scoring.is_held_out(i))
    n, m = 80_000, 2_000
    docs = make_docs([(train, " ".join(f"the s{i}" for i in range(n))), (held, " ".join(f"the u{i}" for i in range(m)))])
    got = {r.doc_id: r for r in lm_scoring.score_texts(docs).collect()}[held]
    total, types, mu = 2 * n + 1, n + 2, lm_scoring.MU
    new, the, end = (x / (total + types + 1) for x in (1, n + 1, 2))
    first = (1 + mu * the) / (1 + mu)  # "the" follows the begin token once
    want = math.log10(first) + m * math.log10(mu * new / (n + mu)) + (m - 1) * math.log10(the) + math.log10(end)
    want += math.log10(mu / (1 + mu))  # "<begin> the" is a context of one
    assert abs(got.score - want) <= got.n_tokens * lm_scoring.STEP


def test_quality_rules_match_sql(spark, make_docs, odd_docs):
    import duckdb

    from rillscope.llm.oracle import quality_rules_sql

    rng = np.random.default_rng(8)
    rows = []
    for i in range(1800):
        w = [f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(15, 60)))]
        if i % 6 == 0:
            w = [x + "!!" for x in w]
        if i % 7 == 0:
            w = w[:12] * 3
        rows.append((i + 100, "\n".join([" ".join(w), *(["same line"] * (i % 4))])))
    docs = make_docs(rows).unionByName(odd_docs)
    labels = [(i + 100, int(i % 6 != 0)) for i in range(1800)] + [(None, 1), (101, None), (6, 1)]
    table = spark.createDataFrame(labels, "doc_id bigint, quality int")
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    con.register("labels", table.toArrow())
    want = con.execute(quality_rules_sql()).fetchall()
    got = quality_rules.quality_verdicts(docs, table).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "stratum").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert any(not r.base_failed and not r.kept for r in got)
