r"""Language-model scores from an Elias-Fano n-gram trie.

*Tokens.*  ASCII-lower-cased words ``[^\x20\x09-\x0D]+`` and one end token per
text.  *Training.*  Texts whose crc32(doc_id as text) mod 7 is not HELD_OUT.

*Model.*  Hierarchical Dirichlet smoothing of order 3: p(w) = (c(w) + 1) / (N +
V + 1), p(w | h) = (c(hw) + MU p(w | h')) / (c(h) + MU) where h' drops the oldest
word of h.  The first word of a text has one begin token as its history, the
second that and the first word.  It sums to one over all words and needs counts
only.

*One scan.*  Texts are read once, in blocks.  What a block needs later (its
words as numbers of its own list) is written to shared storage with the block's
name, so later stages never depend on how the input is split.

*Vocabulary.*  A block sends each distinct word once, with its count in training
texts, to the shard of its hash; the shard adds up, numbers the words that occur
in training texts, the frequent ones first, and answers each block with counts
and numbers.  The base score is made of these exact counts.  From here on words
are exact numbers.

*Tries.*  N-grams are dealt to shards by their first word; those of a frequent
first word by their first two words, and those whose first two words are both
frequent by all three.  Whether a word is frequent follows from its exact count,
so all blocks agree, and no context, however hot, gathers in one task.  A shard
adds up counts and builds one linked :class:`~.elias_fano.Trie`: first words,
monotone pointers to their successors, and pointers from those pairs to theirs.
Pairs and triples hold quantised logarithms of c(uv) / (c(u) + MU) and
c(uvw) / (c(u) + MU); c(u) comes with the request, so no shard needs what another
one has.  The flat image is read in place, and every n-gram that was asked for
is found in it by successor search relative to its context.  From the answers
and the exact c(u) a block gets c(uv) (exact below about a hundred, as it is a
whole number) and so every p.

N-grams with a word that is not in any training text have no count and are not
sent.  An image is queried by the task that built it and is not kept.

Edge cases: a null text is empty (one end token); a null doc_id is in the
training set like any text (its crc32 is null) and scored; repeated rows count
and are scored each; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import GOLD, blocks, drop_part, hash_words, materialize, mix, pack, shards_for, text_bytes, unpack, words_of
from .elias_fano import Trie

MU = 4.0
MODULUS, HELD_OUT = 7, 2
BLOCK_BYTES = 6 << 20
SHARD_TEXT_BYTES = 10 << 20
#: A word with more than this share of what a shard holds on average is frequent.
HOT_SHARE = 1 / 8
LEAST_HOT = 1024
END = np.uint64(0xA24BAED4963EE407)
KEY_SHIFT = np.uint64(8)  # words are told apart by 56 bits of their hashes
#: Quantised log10: number q stands for -q * STEP; the largest for zero.
STEP = 12 / 4094
ZERO = 4095
EXACT = 100  # counts up to this are whole numbers again after dequantising

BLOCK, WORDS, NUMBERS, TOTALS, GRAMS, VALUES = range(6)
FIELDS = "abcdefgh"
SCHEMA = "block bigint, kind int, shard int, n1 bigint, n2 bigint, n3 bigint, " + ", ".join(f"{c} binary" for c in FIELDS)
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
ARROW = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("shard", pa.int32()), *((c, pa.int64()) for c in ("n1", "n2", "n3")), *((c, pa.binary()) for c in FIELDS)])


def quantise(p: np.ndarray) -> np.ndarray:
    """Probabilities to quantised logarithms."""
    with np.errstate(divide="ignore"):
        q = np.rint(-np.log10(p) / STEP)
    return np.where(np.isfinite(q), np.minimum(q, ZERO - 1), ZERO).astype(np.uint16)


def dequantise(q: np.ndarray) -> np.ndarray:
    return np.where(q == ZERO, 0.0, 10.0 ** (-STEP * q.astype(np.float64)))


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % MODULUS == HELD_OUT


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    """The shard of 64-bit hashes; it rises with the hash."""
    return (((h >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def _rows(table: pa.Table) -> list[dict]:
    return [dict(zip(NAMES, r, strict=True)) for r in zip(*(table.column(c).to_pylist() for c in NAMES), strict=True)]


def _slices(shard: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(shard, begin, end) of each run of a sorted array."""
    if len(shard):
        edge = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1], [True])))
        yield from zip(shard[edge[:-1]].tolist(), edge[:-1].tolist(), edge[1:].tolist(), strict=True)


def _deltas(values: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Differences of numbers that rise within runs; ``new`` marks where runs begin, which keep the number itself."""
    out = values.copy()
    if len(out):
        out[1:] -= values[:-1]
        out[new] = values[new]
    return out


def _undo(deltas: np.ndarray, new: np.ndarray) -> np.ndarray:
    total = np.cumsum(deltas.astype(np.uint64))
    begins = np.flatnonzero(new)
    base = total[begins] - deltas[begins].astype(np.uint64)
    return total - np.repeat(base, np.diff(np.append(begins, len(deltas))))


def _list_words(block: pa.RecordBatch, name: int, shards: int) -> list[dict]:
    """The block itself, as numbers of its sorted list of word hashes, and its requests."""
    codes, offsets, words = words_of(block.column("text"))
    h = hash_words(pc.ascii_lower(words)) | np.uint64((1 << int(KEY_SHIFT)) - 1)
    keys, which = np.unique(np.append(h, END | np.uint64((1 << int(KEY_SHIFT)) - 1)), return_inverse=True)
    sizes = np.diff(offsets)
    n = len(sizes)
    seq = np.full(len(codes) + n, which[-1], np.int64)
    seq[np.arange(len(codes)) + np.repeat(np.arange(n), sizes)] = which[codes]
    ids = block.column("doc_id").to_pylist()
    held = np.array([is_held_out(d) for d in ids], bool)
    count = np.bincount(seq, weights=np.repeat(~held, sizes + 1), minlength=len(keys)).astype(np.uint32)
    flags = held.astype(np.uint8) | np.array([d is None for d in ids], np.uint8) << 1
    out = [{"block": name, "kind": BLOCK, "shard": -1, "n1": n, "n2": len(seq), "n3": len(keys), "a": pack(seq.astype(np.uint32)), "b": pack((sizes + 1).astype(np.uint32)), "c": pack(np.array([d or 0 for d in ids], np.int64)), "d": pack(flags), "f": pack(_shard(keys, shards).astype(np.int32))}]
    for s, a, b in _slices(_shard(keys, shards)):
        part = keys[a:b] >> KEY_SHIFT
        out.append({"block": name, "kind": WORDS, "shard": s, "n1": b - a, "a": pack(np.diff(part, prepend=np.uint64(0))), "b": pack(count[a:b])})
    return out


def _number(table: pa.Table, shards: int) -> pa.Table:
    """Total counts and numbers (from 1; 0 for words without a count) of a shard's words, for each block that asks."""
    rows = _rows(table)
    keys, which = np.unique(np.concatenate([np.cumsum(unpack(r["a"], r["n1"], np.uint64)) for r in rows]), return_inverse=True)
    count = np.bincount(which, weights=np.concatenate([unpack(r["b"], r["n1"], np.uint32) for r in rows]), minlength=len(keys)).astype(np.int64)
    rank = np.empty(len(keys), np.int64)
    rank[np.argsort(-count, kind="stable")] = np.arange(len(keys))
    number = np.where(count > 0, rank * shards + rows[0]["shard"] + 1, 0)
    if len(number) and number.max() >= 1 << 32:
        raise ValueError("more than 2^32 words")
    out, at = [], 0
    for r in rows:
        mine = which[at : at + r["n1"]]
        out.append({"block": r["block"], "kind": NUMBERS, "shard": r["shard"], "n1": r["n1"], "a": pack(number[mine].astype(np.uint32)), "b": pack(count[mine])})
        at += r["n1"]
    out.append({"block": -1, "kind": TOTALS, "shard": rows[0]["shard"], "n1": int(count.sum()), "n2": int((count > 0).sum()), "n3": int(number.max(initial=0))})
    return pa.Table.from_pylist(out, schema=ARROW)


class _Grams:
    """The tokens of a block and its distinct pairs and triples, dealt to shards."""

    def __init__(self, rows: list[dict], shards: int, hot: float):
        head = next(r for r in rows if r["kind"] == BLOCK)
        self.n_docs = head["n1"]
        seq, ends = unpack(head["a"], head["n2"], np.uint32).astype(np.int64), np.cumsum(unpack(head["b"], head["n1"], np.uint32).astype(np.int64))
        flags = unpack(head["d"], head["n1"], np.uint8)
        self.held, self.null = (flags & 1) > 0, (flags & 2) > 0
        self.doc_ids = unpack(head["c"], head["n1"], np.int64)
        shard = unpack(head["f"], head["n3"], np.int32)
        number, count = np.zeros(head["n3"], np.uint64), np.zeros(head["n3"], np.int64)
        for r in rows:
            if r["kind"] == NUMBERS:
                a = int(np.searchsorted(shard, r["shard"]))
                number[a : a + r["n1"]], count[a : a + r["n1"]] = unpack(r["a"], r["n1"], np.uint32), unpack(r["b"], r["n1"], np.int64)
        self.doc = np.repeat(np.arange(self.n_docs), np.diff(ends, prepend=0))
        self.count = count[seq]
        train = ~self.held[self.doc]
        first = np.zeros(len(seq), bool)
        first[np.concatenate(([0], ends[:-1])).astype(np.int64)] = len(seq) > 0
        # The begin token has the number 0 and the end token's count: one for each training text.
        begins = int(count[seq[-1]]) if len(seq) else 0
        w = number[seq]
        ok = self.count > 0
        u = np.where(first, np.uint64(0), np.roll(w, 1))
        self.total = np.where(first, begins, np.roll(self.count, 1))  # of the word before
        fine = ok & (first | np.roll(ok, 1)) & (begins > 0)
        at = np.flatnonzero(fine)
        pairs, place = np.unique(u[at] << np.uint64(32) | w[at], return_inverse=True)
        self.pair = np.full(len(seq), -1)
        self.pair[at] = place
        pair_count = np.bincount(place, weights=train[at], minlength=len(pairs)).astype(np.int64)
        # A triple's context is the pair that ends one token earlier.
        self.context = np.where(first, -1, np.roll(self.pair, 1))
        at = np.flatnonzero((self.context >= 0) & ok)
        triples, place = np.unique(self.context[at].astype(np.uint64) << np.uint64(32) | w[at], return_inverse=True)
        self.triple = np.full(len(seq), -1)
        self.triple[at] = place
        triple_count = np.bincount(place, weights=train[at], minlength=len(triples)).astype(np.int64)
        context, third = (triples >> np.uint64(32)).astype(np.int64), (triples & np.uint64(0xFFFFFFFF)).astype(np.uint32)

        first_word, second = pairs >> np.uint64(32), (pairs & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        known = np.argsort(number, kind="stable")
        total = np.append(count, begins)  # of each word by number, and of the begin token
        by_number = lambda x: np.where(x == 0, begins, total[known[np.minimum(np.searchsorted(number[known], x), len(known) - 1)]])
        self.first_total = by_number(first_word) if len(pairs) else np.zeros(0, np.int64)
        hot_first = self.first_total > hot
        hot_both = hot_first & (by_number(second.astype(np.uint64)) > hot) if len(pairs) else hot_first
        h = mix(first_word + GOLD)
        home = _shard(np.where(hot_first, mix(h ^ (second + GOLD)), h), shards)
        goes = _shard(mix(mix(h[context] ^ (second[context] + GOLD)) ^ (third + GOLD)), shards)
        goes = np.where(hot_both[context], goes, home[context])
        # Pairs in the order of their shards; with the pairs that lead to triples in other shards.
        bits = np.uint64(32)
        away = goes != home[context]
        nodes = np.unique(np.concatenate((home.astype(np.uint64) << bits | np.arange(len(pairs), dtype=np.uint64), goes[away].astype(np.uint64) << bits | context[away].astype(np.uint64))))
        self.node_shard, self.node = (nodes >> bits).astype(np.int64), (nodes & np.uint64(0xFFFFFFFF)).astype(np.int64)
        self.is_home = home[self.node] == self.node_shard
        self.order = np.argsort(goes, kind="stable")
        self.triple_shard = goes[self.order]
        self.parent = np.searchsorted(nodes, self.triple_shard.astype(np.uint64) << bits | context[self.order].astype(np.uint64))
        self.n_pairs, self.n_triples = len(pairs), len(triples)
        self.first_word, self.second, self.third = first_word.astype(np.uint32), second, third
        self.pair_count, self.triple_count = pair_count, triple_count

    def asks(self, name: int) -> list[dict]:
        out = []
        third, count = self.third[self.order], self.triple_count[self.order].astype(np.uint32)
        edges = np.searchsorted(self.triple_shard, np.arange(int(self.node_shard[-1]) + 2)) if len(self.node) else None
        for s, a, b in _slices(self.node_shard):
            x, y = int(edges[s]), int(edges[s + 1])
            node = self.node[a:b]
            u, v = self.first_word[node], self.second[node]
            new = np.concatenate(([True], u[1:] != u[:-1]))
            roots = np.flatnonzero(new)
            parent = self.parent[x:y] - a
            new3 = np.concatenate(([True], parent[1:] != parent[:-1])) if y > x else np.zeros(0, bool)
            data = [
                np.diff(u[roots], prepend=np.uint32(0)), np.diff(np.append(roots, b - a)).astype(np.uint32), self.first_total[node[roots]], _deltas(v, new), np.where(self.is_home[a:b], self.pair_count[node], 0).astype(np.uint32),
                np.bincount(parent, minlength=b - a).astype(np.uint32), _deltas(third[x:y], new3), count[x:y],
            ]
            out.append({"block": name, "kind": GRAMS, "shard": s, "n1": len(roots), "n2": b - a, "n3": y - x, **dict(zip(FIELDS, map(pack, data), strict=True))})
        return out

    def values(self, rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        """c(uv) of each pair and c(uvw) of each triple, from the shards' answers."""
        pair, triple = np.full(self.n_pairs, ZERO, np.uint16), np.full(self.n_triples, ZERO, np.uint16)
        for r in rows:
            if r["kind"] == VALUES:
                a = int(np.searchsorted(self.node_shard, r["shard"]))
                part = slice(a, a + r["n2"])
                mine = self.is_home[part]
                pair[self.node[part][mine]] = unpack(r["a"], r["n2"], np.uint16)[mine]
                a = int(np.searchsorted(self.triple_shard, r["shard"]))
                triple[self.order[a : a + r["n3"]]] = unpack(r["b"], r["n3"], np.uint16)
        first = np.zeros(self.n_triples, np.int64)
        first[self.order] = self.node[self.parent]
        return tuple(np.where(c < EXACT, np.rint(c), c) for c in (dequantise(pair) * (self.first_total + MU), dequantise(triple) * (self.first_total[first] + MU)))


def _decoded(r: dict) -> tuple[np.ndarray, ...]:
    """Pairs (u, v, count, c(u)) and triples (parent, w, count) of a block's request."""
    n1, n2, n3 = r["n1"], r["n2"], r["n3"]
    size = unpack(r["b"], n1, np.uint32).astype(np.int64)
    u, total = np.repeat(np.cumsum(unpack(r["a"], n1, np.uint32).astype(np.uint64)), size), np.repeat(unpack(r["c"], n1, np.int64), size)
    new = np.zeros(n2, bool)
    new[np.cumsum(size) - size] = True
    v = _undo(unpack(r["d"], n2, np.uint32), new)
    below = unpack(r["f"], n2, np.uint32).astype(np.int64)
    parent = np.repeat(np.arange(n2), below)
    new = np.zeros(n3, bool)
    new[(np.cumsum(below) - below)[below > 0]] = True
    w = _undo(unpack(r["g"], n3, np.uint32), new)
    return u, v, unpack(r["e"], n2, np.uint32), total, parent, w, unpack(r["h"], n3, np.uint32)


def build_trie(pairs: np.ndarray, pair_count: np.ndarray, total: np.ndarray, triples: np.ndarray, triple_count: np.ndarray, span: int) -> Trie:
    """The trie of all pairs (u << 32 | v) and triples (place of the pair << 32 | w) with a count; both sorted."""
    bits, low = np.uint64(32), np.uint64(0xFFFFFFFF)
    seen = triple_count > 0
    context = (triples[seen] >> bits).astype(np.int64)
    keep = pair_count > 0
    keep[context] = True
    place = np.cumsum(keep) - 1
    u, v, c, t = pairs[keep] >> bits, pairs[keep] & low, pair_count[keep], total[keep] + MU
    return Trie.build(u, v, quantise(c / t), place[context], triples[seen] & low, quantise(triple_count[seen] / (total[context] + MU)), span)


def _answer(table: pa.Table, span: int) -> pa.Table:
    rows = _rows(table)
    parts = [_decoded(r) for r in rows]
    bits = np.uint64(32)
    u, v, count, total, w, c3 = (np.concatenate([p[k] for p in parts]) for k in (0, 1, 2, 3, 5, 6))
    pairs, at, which = np.unique(u << bits | v, return_index=True, return_inverse=True)
    total = total[at]
    del u, v
    pair_count = np.bincount(which, weights=count, minlength=len(pairs)).astype(np.int64)
    begin = np.cumsum([0, *(len(p[0]) for p in parts)])
    context = which[np.concatenate([p[4] + b for p, b in zip(parts, begin[:-1], strict=True)])] if len(w) else np.zeros(0, np.int64)
    triples, which3 = np.unique(context.astype(np.uint64) << bits | w, return_inverse=True)
    triple_count = np.bincount(which3, weights=c3, minlength=len(triples)).astype(np.int64)
    del parts, count, c3, w, context
    trie = Trie.load(build_trie(pairs, pair_count, total, triples, triple_count, span).dump())
    low = np.uint64(0xFFFFFFFF)
    place = trie.find_pairs(pairs >> bits, pairs & low)
    found = trie.find_triples(place[(triples >> bits).astype(np.int64)], triples & low)
    pair_value, triple_value = np.append(trie.values[0], np.uint16(ZERO))[place], np.append(trie.values[1], np.uint16(ZERO))[found]
    out, a, b = [], 0, 0
    for r in rows:
        out.append({"block": r["block"], "kind": VALUES, "shard": r["shard"], "n2": r["n2"], "n3": r["n3"], "a": pack(pair_value[which[a : a + r["n2"]]]), "b": pack(triple_value[which3[b : b + r["n3"]]])})
        a, b = a + r["n2"], b + r["n3"]
    return pa.Table.from_pylist(out, schema=ARROW)


def score_texts(docs: DataFrame, hot: float | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of all texts.

    ``hot``: the count above which a word is frequent (by default HOT_SHARE of a
    shard's tokens).
    """
    spark = docs.sparkSession
    shards = shards_for(text_bytes(docs), SHARD_TEXT_BYTES)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for number, block in enumerate(blocks(batches, "text", block_bytes)):
            yield pa.RecordBatch.from_pylist(_list_words(block, (task << 32) | number, shards), schema=ARROW)

    made = materialize(spark, texts.mapInArrow(read, SCHEMA), "blocks", "kind")
    words = materialize(spark, made.where(f"kind = {WORDS}").groupBy("shard").applyInArrow(lambda t: _number(t, shards), SCHEMA), "words", "kind")
    drop_part(made, f"kind={WORDS}")
    totals = words.where(f"kind = {TOTALS}").agg(F.sum("n1").alias("n"), F.sum("n2").alias("v"), F.max("n3").alias("most")).first()
    n_train, n_types, span = totals.n or 0, totals.v or 0, 1 << int((totals.most or 0) + 1).bit_length()
    limit = max(LEAST_HOT, n_train / shards * HOT_SHARE) if hot is None else hot
    numbered = made.where(f"kind = {BLOCK}").unionByName(words.where(f"kind = {NUMBERS}"))

    def ask(table: pa.Table) -> pa.Table:
        rows = _rows(table)
        return pa.Table.from_pylist(_Grams(rows, shards, limit).asks(rows[0]["block"]), schema=ARROW)

    asked = numbered.groupBy("block").applyInArrow(ask, SCHEMA)
    values = materialize(spark, asked.groupBy("shard").applyInArrow(lambda t: _answer(t, span), SCHEMA), "values")

    def score(table: pa.Table) -> pa.Table:
        rows = _rows(table)
        g = _Grams(rows, shards, limit)
        pair, triple = (np.append(c, 0.0) for c in g.values(rows))
        p = (g.count + 1) / (n_train + n_types + 1)
        base = np.log10(p)
        p = (pair[g.pair] + MU * p) / (g.total + MU)
        history = pair[g.context]  # how often the two words before occur
        p = np.where(history > 0, (triple[g.triple] + MU * p) / (history + MU), p)
        per = lambda x: np.bincount(g.doc, weights=x, minlength=g.n_docs)
        return pa.table(
            {
                "doc_id": pa.array(g.doc_ids, pa.int64(), mask=g.null),
                "held_out": pa.array(g.held),
                "n_tokens": pa.array(per(np.ones(len(p))).astype(np.int64)),
                "n_known": pa.array(per(g.count > 0).astype(np.int64)),
                "train_tokens": pa.array(np.full(g.n_docs, n_train, np.int64)),
                "base_score": pa.array(per(base)),
                "score": pa.array(per(np.log10(p))),
            }
        )

    return numbered.unionByName(values).groupBy("block").applyInArrow(score, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
