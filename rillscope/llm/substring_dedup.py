"""Near-duplicate passages by compact windows of min-hashes.

*Compact windows.*  The tokens are word shingles.  For one of HASHES hash
functions, (l, c, r) stands for all subsequences that begin in [l, c], end in
[c, r] and so have their least hash at c: a node of the Cartesian tree over the
token hashes.  Only nodes that hold a subsequence of at least the passage
length are made: their centres are the places of the sliding-window minima
(about 2n / length of them), and their bounds are the nearest smaller centres,
found by pointer jumping (a centre's nearest smaller token is a centre itself).

*Groups.*  Windows with an equal least hash are one group.  Blocks send each
distinct hash once, with the least documents that have it; the shard of the
hash answers with the least documents of the whole group and whether it has
more.

*Interval join.*  For a document and an earlier one, the windows of all
functions are laid over each other; the pair is a candidate where windows of at
least MIN_HITS functions have a passage in common.  Passages with a similarity of 0.8 collide in
so many of 5 functions with a probability of 0.993 for each window length.

*Rounds.*  The first round compares a document with the least one of each
group.  That settles groups of two, and those of copies without expanding them.
A window of a larger group goes on if MIN_HITS functions collide in one of its
passages, unless a passage verified as equal covers it; it is open unless some verified passage covers it.  In the next round all
shingles near such windows are counted by documents, and hash functions put the
ones of more than RARE documents after all others: so a frequent phrase in
passages that differ otherwise makes no group, and a group either has RARE
documents at most, which are all compared, or consists of passages made of
frequent shingles only, which are compared with their LEADERS least ones; what
is still open after that meets four times as many in each later round (sixteen times
as many after a round of few new pairs), until no open window is in a group with
documents left.  No group is cut short, and no pair is compared twice.  A passage
that a verified one covers as a whole is not compared further, so a document has
a source for each of its passages rather than all of them.

*Verification.*  With both texts at hand, runs of the document's shingles that
occur in the earlier one are joined while at least 2s/(1+s) of the joined
shingles occur there (for runs of equal length that is a Jaccard similarity of
s), and kept from PASSAGE words on if as many of them stand within as many
shingles of the earlier document; shorter ones are first extended by up to
WIDTH - 1 shingles at either end, the earlier end first, to that length.

Edge cases: a null text has no passages; a null doc_id is neither compared nor
reported; rows that share a ``doc_id`` are not compared with each other, and
``text_key`` (a hash of the text) tells their passages apart; texts shorter than
a passage have none; very long texts are a block of their own; repeated rows
report their passages once; an empty table gives an empty result; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import GOLD, blocks, discard, distinct, fresh, hash_words, materialize, mix, pack, ragged, shards_for, shingle_hashes, text_bytes, unpack, words_of

WIDTH = 5
PASSAGE = 50
SIMILARITY = 0.8
HASHES = 5
MIN_HITS = 2
RARE = 16
LEADERS = 16
FEW = 2000
LONG = 32
BLOCK_BYTES = 4 << 20
SHARD_TEXT_BYTES = 24 << 20
MASK = (1 << 64) - 1


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of distinct words, of all words at once by eight bytes at a time; of words over LONG bytes the library's."""
    if not len(words):
        return np.zeros(0, np.uint64)
    words = words.cast(pa.large_binary())
    at = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data, sizes = np.append(np.frombuffer(words.buffers()[2], np.uint8), np.zeros(8, np.uint8)), np.diff(at)
    out = mix(sizes.astype(np.uint64) * GOLD)
    for k in range(0, min(LONG, int(sizes.max())), 8):
        mine = np.flatnonzero(sizes > k)
        part = data[(at[mine] + k)[:, None] + np.arange(8)].view("<u8").reshape(-1)
        unused = 8 * np.maximum(0, k + 8 - sizes[mine]).astype(np.uint64)
        out[mine] = mix(out[mine] ^ (part << unused))
    long = np.flatnonzero(sizes > LONG)
    out[long] = hash_words(words.take(pa.array(long)))
    return out


def window_minima(h: np.ndarray, length: int) -> np.ndarray:
    """Places of a least value of all windows of ``length`` values, each place once."""
    n = len(h)
    if n < length:
        return np.zeros(0, np.int64)
    # The low bits of a value make room for the place modulo a power of two above the length.
    bits = np.uint64(max(1, (2 * length - 1).bit_length()))
    low = np.uint64((1 << int(bits)) - 1)
    m = (h & ~low) | (np.arange(n, dtype=np.uint64) & low)
    size = 1
    while size * 2 <= length:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    rest = length - size
    m = np.minimum(m[: n - length + 1], m[rest : rest + n - length + 1]) if rest else m[: n - length + 1]
    start = np.arange(len(m), dtype=np.int64)
    place = start + (((m & low).astype(np.int64) - start) & int(low))
    return distinct(place[np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))])


def nearest_smaller(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest smaller (or equal and earlier) value on the left, and of the nearest smaller on the right; -1 and n for none."""
    n = len(values)

    def left(v: np.ndarray, strict: bool) -> np.ndarray:
        p = np.arange(-1, n - 1)
        todo = np.flatnonzero(p >= 0)
        while len(todo):
            q = p[todo]
            above = v[q] >= v[todo] if strict else v[q] > v[todo]
            todo = todo[above]
            p[todo] = p[p[todo]]
            todo = todo[p[todo] >= 0]
        return p

    return left(values, False), n - 1 - left(values[::-1], True)[::-1]


def compact_windows(h: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r), inclusive places, of all compact windows of at least ``length`` tokens of texts given one after another."""
    n_texts, n = len(ends) - 1, len(h)
    # A least value between texts keeps windows inside them.
    at = np.arange(n) + np.repeat(np.arange(1, n_texts + 1), np.diff(ends))
    spread = np.zeros(n + n_texts + 1, np.uint64)
    spread[at] = h | np.uint64(1 << 63)
    bits = max(1, (2 * length - 1).bit_length())
    coarse = spread >> np.uint64(bits)
    c = window_minima(spread, length)
    c = c[coarse[c] > 0]
    walls = ends + np.arange(n_texts + 1)
    c = distinct(np.concatenate((c, walls)))
    left, right = nearest_smaller(coarse[c])
    real = coarse[c] > 0
    l, r = c[left[real]] + 1, c[np.minimum(right[real], len(c) - 1)] - 1
    c = c[real]
    text = np.searchsorted(walls, c) - 1
    keep = r - l + 1 >= length
    shift = text[keep] + 1
    return l[keep] - shift, c[keep] - shift, r[keep] - shift


def _seeded(h: np.ndarray, f: int) -> np.ndarray:
    return mix(h ^ np.uint64((f + 1) * int(GOLD) & MASK))


SCHEMA = "block bigint, kind int, shard int, n bigint, m bigint, a binary, b binary, c binary, d binary"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
ARROW = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("shard", pa.int32()), ("n", pa.int64()), ("m", pa.int64()), *((c, pa.binary()) for c in "abcd")])
HELD, ASK, ANSWER, SEGMENTS, COUNT, FREQUENT, PAIR, ON, SPAN = range(9)


def _rows(table: pa.Table) -> list[dict]:
    return [dict(zip(NAMES, r, strict=True)) for r in zip(*(table.column(c).to_pylist() for c in NAMES), strict=True)]


def _runs(x: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """Where runs of equal rows of sorted arrays begin, and the end of the last."""
    if not len(x):
        return np.zeros(1, np.int64)
    new = x[1:] != x[:-1]
    for y in more:
        new |= y[1:] != y[:-1]
    return np.flatnonzero(np.concatenate(([True], new, [True])))


def _least_owners(keys: np.ndarray, owners: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the number of distinct owners of each (as far as ``most``), and those, the least ones, one key after another."""
    order = np.lexsort((owners, keys))
    keys, owners = keys[order], owners[order]
    at = _runs(keys, owners)[:-1]
    keys, owners = keys[at], owners[at]
    edge = _runs(keys)
    rank = np.arange(len(keys)) - np.repeat(edge[:-1], np.diff(edge))
    return keys[edge[:-1]], np.minimum(np.diff(edge), most), owners[rank < most]


def _by_shard(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The shard of each key, and the order of the keys by shard."""
    shard = (keys % np.uint64(shards)).astype(np.int64)
    return shard, np.argsort(shard, kind="stable")


def _ask_owners(name: int, shards: int, most: int, key: np.ndarray, text: np.ndarray, windows: np.ndarray, doc_ids: np.ndarray) -> list[dict]:
    """A block's windows (rows of ``windows``: lo, hi, mid, function, open) and its requests for the least owners of their keys."""
    if not len(key):
        return []
    keys, counts, owners = _least_owners(key, doc_ids[text], most + 1)
    shard, order = _by_shard(keys, shards)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    place = rank[np.searchsorted(keys, key)]
    starts = np.cumsum(counts) - counts
    out = [{"block": name, "kind": HELD, "shard": -1, "n": len(key), "m": len(doc_ids), "a": pack(np.concatenate((place[None], text[None], windows)).astype(np.uint32).reshape(-1)), "b": pack(doc_ids), "c": pack(shard[order].astype(np.int32))}]
    edge = _runs(shard[order])
    for x, y in zip(edge[:-1], edge[1:], strict=True):
        mine = order[x:y]
        sent = owners[ragged(starts[mine], counts[mine])]
        out.append({"block": name, "kind": ASK, "shard": int(shard[mine[0]]), "n": y - x, "m": len(sent), "a": pack(keys[mine]), "b": pack(counts[mine]), "c": pack(sent)})
    return out


def _answer_owners(table: pa.Table, most: int, lead: int) -> pa.Table:
    """For every key of more than one document its ``lead`` least owners (all, if it has ``most`` at most), and whether it has more."""
    rows = _rows(table)
    keys = [unpack(r["a"], r["n"], np.uint64) for r in rows]
    counts = [unpack(r["b"], r["n"], np.int64) for r in rows]
    owners = np.concatenate([unpack(r["c"], r["m"], np.int64) for r in rows])
    uniq, total, least = _least_owners(np.repeat(np.concatenate(keys), np.concatenate(counts)), owners, most + 1)
    starts = np.cumsum(total) - total
    given = np.where(total == 1, 0, np.where(total > most, min(lead, most), total))
    out = []
    for r, k in zip(rows, keys, strict=True):
        at = np.searchsorted(uniq, k)
        n = given[at]
        if n.any():
            sent = least[ragged(starts[at], n)]
            out.append({"block": r["block"], "kind": ANSWER, "shard": r["shard"], "n": r["n"], "m": len(sent), "a": pack(n), "b": pack(sent), "c": pack(((total[at] > n) & (n > 0)).astype(np.uint8))})
    return pa.Table.from_pylist(out, schema=ARROW)


def _windows(docs: DataFrame, width: int, passage: int, hashes: int, shards: int) -> DataFrame:
    """All blocks' windows and requests of the first round."""
    length = passage - width + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for number, block in enumerate(blocks(batches, "text", BLOCK_BYTES)):
            codes, offsets, words = words_of(block.column("text"))
            h, ends = shingle_hashes(codes, offsets, word_hashes(words), width)
            key, text, windows = _all_windows(h, ends, hashes, length, np.zeros(len(h), bool))
            windows = np.concatenate((windows, np.ones((1, len(key)), np.int64)))
            yield pa.RecordBatch.from_pylist(_ask_owners((task << 32) | number, shards, 1, key, text, windows, np.asarray(block.column("doc_id"), dtype=np.int64)), schema=ARROW)

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def _all_windows(h: np.ndarray, ends: np.ndarray, hashes: int, length: int, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, text numbers and (lo, hi, mid, function) of the windows of all functions; frequent shingles come after all others."""
    last = frequent.astype(np.uint64) << np.uint64(62)
    parts = []
    for f in range(hashes):
        g = _seeded(h, f)
        lo, c, hi = compact_windows((g >> np.uint64(2)) | last, ends, length)
        text = np.searchsorted(ends, c, side="right") - 1
        parts.append((g[c], text, np.stack([lo - ends[text], hi - ends[text], c - ends[text], np.full(len(c), f)])))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts], axis=1)


def starts_of(lo: np.ndarray, hi: np.ndarray, mid: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last start of the passages of ``length`` shingles that lie in a window and hold its centre."""
    return np.maximum(lo, mid - length + 1), np.minimum(mid, hi - length + 1)


def meeting(group: np.ndarray, first: np.ndarray, last: np.ndarray, fn: np.ndarray, hits: int) -> np.ndarray:
    """For each window, whether some passage of it is also one of windows of other functions in its group, of ``hits`` functions in all."""
    if not len(group):
        return np.zeros(0, bool)
    # Each group has a stretch of its own on one line of passage starts.
    known, at = np.unique(group, return_inverse=True)
    low, high = np.full(len(known), np.iinfo(np.int64).max), np.zeros(len(known), np.int64)
    np.minimum.at(low, at, first)
    np.maximum.at(high, at, last)
    ends = np.cumsum(high - low + 2)
    shift = (ends - (high - low + 2) - low)[at]
    begin, end = first + shift, last + shift
    total = np.zeros(int(ends[-1]) + 1, np.uint8)
    for f in np.flatnonzero(np.bincount(fn)):
        mine = fn == f
        edge = np.bincount(begin[mine], minlength=len(total)) - np.bincount(end[mine] + 1, minlength=len(total))
        total += np.cumsum(edge) > 0
    before = np.concatenate(([0], np.cumsum(total >= hits)))
    return before[end + 1] > before[begin]


def _joined(table: pa.Table, hits: int, length: int) -> pa.Table:
    """Rows PAIR: (a, b) that collide in enough functions in one passage; ON: the windows of groups that have more documents, as far as enough functions collide there at all."""
    rows = _rows(table)
    head = next(r for r in rows if r["kind"] == HELD)
    doc_ids = unpack(head["b"], head["m"], np.int64)
    held = unpack(head["a"], 7 * head["n"], np.uint32).astype(np.int64).reshape(7, -1)
    place = held[0]
    n_keys = int(place.max()) + 1
    shard = unpack(head["c"], n_keys, np.int32)
    count, first, more, found, base = np.zeros(n_keys, np.int64), np.zeros(n_keys, np.int64), np.zeros(n_keys, bool), [np.zeros(0, np.int64)], 0
    for r in rows:
        if r["kind"] == ANSWER:
            at = int(np.searchsorted(shard, r["shard"]))
            part = slice(at, at + r["n"])
            count[part], more[part] = unpack(r["a"], r["n"], np.int64), unpack(r["c"], r["n"], np.uint8) > 0
            first[part] = base + np.cumsum(count[part]) - count[part]
            found.append(unpack(r["b"], r["m"], np.int64))
            base += r["m"]
    owners = np.concatenate(found)
    out = []
    _, text, lo, hi, mid, fn, is_open = held
    begin, end = starts_of(lo, hi, mid, length)
    shared = np.flatnonzero(count[place] > 0)
    on = np.zeros(len(place), bool)
    on[shared] = meeting(text[shared], begin[shared], end[shared], fn[shared], hits)
    on &= more[place]
    if on.any():
        out.append({"block": head["block"], "kind": ON, "n": int(on.sum()), "m": len(doc_ids), "a": pack(held[1:5, on].astype(np.uint32).reshape(-1)), "b": head["b"]})
    seek = np.flatnonzero(is_open > 0)
    n = count[place[seek]]
    at = np.repeat(seek, n)
    a = owners[ragged(first[place[seek]], n)]
    go = a < doc_ids[text[at]]
    at, a = at[go], a[go]
    # Windows of the same document that lead to the same earlier one.
    order = np.lexsort((a, text[at]))
    at, a = at[order], a[order]
    edges = _runs(text[at], a)
    pair = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    met = distinct(pair[meeting(pair, begin[at], end[at], fn[at], hits)])
    pairs = np.stack([a[edges[met]], doc_ids[text[at[edges[met]]]]], axis=1) if len(met) else np.zeros((0, 2), np.int64)
    if len(pairs):
        out.append({"block": head["block"], "kind": PAIR, "n": len(pairs), "a": pack(np.ascontiguousarray(pairs[:, 0])), "b": pack(np.ascontiguousarray(pairs[:, 1]))})
    return pa.Table.from_pylist(out, schema=ARROW)


def _pairs(found: DataFrame) -> DataFrame:
    """(a, b) of the rows PAIR."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, a, b in zip(*(batch.column(c).to_pylist() for c in "nab"), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(unpack(x, n, np.int64)) for x in (a, b)], names=["a", "b"])

    return found.where(f"kind = {PAIR}").select("n", "a", "b").mapInArrow(run, "a bigint, b bigint").distinct()


def _round(made: DataFrame, tag: str, most: int, lead: int, hits: int, length: int) -> DataFrame:
    """Rows PAIR and ON of the windows and requests of ``made``, which go."""
    answers = made.where(f"kind = {ASK}").groupBy("shard").applyInArrow(lambda t: _answer_owners(t, most, lead), SCHEMA)
    out = materialize(made.sparkSession, made.where(f"kind = {HELD}").unionByName(answers).groupBy("block").applyInArrow(lambda t: _joined(t, hits, length), SCHEMA), tag, "kind")
    discard(made)
    return out


def _merged(doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The unions of intervals of the same document that overlap or touch, in order."""
    order = np.lexsort((begin, doc))
    doc, begin, end = doc[order], begin[order], end[order]
    reach = np.maximum.accumulate((doc << 32) + end) if len(doc) else end
    new = np.flatnonzero(np.concatenate(([True], ((doc << 32) + begin)[1:] > reach[:-1]))) if len(doc) else np.zeros(0, np.int64)
    return doc[new], begin[new], reach[np.append(new[1:], len(doc)) - 1] & 0xFFFFFFFF if len(doc) else end


def _regions(on: DataFrame, spans: DataFrame, width: int, passage: int, buckets: int) -> DataFrame:
    """(id, begins, ends, open_begins, open_ends) of documents with windows that are not settled: where these are, in shingles, and where they are open."""
    length = passage - width + 1

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, m, a, b in zip(*(batch.column(c).to_pylist() for c in "nmab"), strict=True):
                text, lo, hi, mid = unpack(a, 4 * n, np.uint32).astype(np.int64).reshape(4, -1)
                begin, end = np.maximum(lo, mid - length + 1), np.minimum(hi, mid + length - 1) + 1
                rows = np.unique(np.stack([unpack(b, m, np.int64)[text], begin, end]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names=["id", "begin", "end"])

    windows = on.where(f"kind = {ON}").select("n", "m", "a", "b").mapInArrow(unfold, "id bigint, begin bigint, end bigint")
    seen = spans.select(F.col("doc_id").alias("id"), F.col("first_word").alias("begin"), (F.col("first_word") + F.col("n_words") - (width - 1)).alias("end"), (F.col("similarity") == 1).cast("int").alias("equal"))
    both = windows.select("id", "begin", "end", F.lit(-1).alias("equal")).unionByName(seen)

    def settle(table: pa.Table) -> pa.Table:
        ids, doc = np.unique(table.column("id").to_numpy(), return_inverse=True)
        begin, end, kind = (table.column(c).to_numpy() for c in ("begin", "end", "equal"))
        base = doc.astype(np.int64) << 32
        mine = np.flatnonzero(kind < 0)

        def inside(spans: np.ndarray) -> np.ndarray:
            order = spans[np.argsort((base + begin)[spans], kind="stable")]
            furthest = np.maximum.accumulate(np.append(np.int64(-1), (base + end)[order]))
            return furthest[np.searchsorted((base + begin)[order], (base + begin)[mine], side="right")] >= (base + end)[mine]

        keep, closed = ~inside(np.flatnonzero(kind == 1)), inside(np.flatnonzero(kind >= 0))
        whole, opened = mine[keep], mine[keep & ~closed]
        found, out = [_merged(doc[x], begin[x], end[x]) for x in (whole, opened)], {}
        here = distinct(found[0][0])
        for (d, x, y), name in zip(found, ("", "open_"), strict=True):
            at = pa.array(np.append(np.searchsorted(d, here), len(d)), pa.int32())
            out |= {f"{name}begins": pa.ListArray.from_arrays(at, pa.array(x, pa.int64())), f"{name}ends": pa.ListArray.from_arrays(at, pa.array(y, pa.int64()))}
        return pa.table({"id": pa.array(ids[here], pa.int64()), **out})

    return both.groupBy(F.pmod(F.xxhash64("id"), F.lit(buckets)).alias("bucket")).applyInArrow(settle, "id bigint, begins array<bigint>, ends array<bigint>, open_begins array<bigint>, open_ends array<bigint>")


def _small(df: DataFrame) -> DataFrame:
    """With a hint: sent to all tasks if it has been counted to hold FEW rows at most, else merged."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df.hint("merge")


def _segments(docs: DataFrame, regions: DataFrame, width: int, shards: int) -> DataFrame:
    """Blocks of the shingles near unsettled windows (kind SEGMENTS), and requests for how many documents have each (COUNT)."""
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("id"), "text").join(_small(regions), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for number, block in enumerate(blocks(batches, "text", BLOCK_BYTES)):
            codes, offsets, words = words_of(block.column("text"))
            h, ends = shingle_hashes(codes, offsets, word_hashes(words), width)
            hashes, opens, head = [], [], []
            for i, (doc, begins, stops, open_begins, open_stops) in enumerate(zip(*(block.column(c).to_pylist() for c in ("id", "begins", "ends", "open_begins", "open_ends")), strict=True)):
                n = int(ends[i + 1] - ends[i])
                is_open = np.zeros(n, bool)
                for a, b in zip(open_begins, open_stops, strict=True):
                    is_open[a:b] = True
                for a, b in zip(begins, stops, strict=True):
                    if b <= n:  # else of another text with this doc_id
                        hashes.append(h[ends[i] + a : ends[i] + b])
                        opens.append(is_open[a:b])
                        head.append((doc, a, b - a))
            if not head:
                continue
            flat, head = np.concatenate(hashes), np.array(head, np.int64)
            uniq, counts, _ = _least_owners(flat, np.repeat(head[:, 0], head[:, 2]), RARE + 1)
            shard, order = _by_shard(uniq, shards)
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            name = (task << 32) | number
            out = [{"block": name, "kind": SEGMENTS, "shard": -1, "n": len(head), "m": len(uniq), "a": pack(head.reshape(-1)), "b": pack(rank[np.searchsorted(uniq, flat)].astype(np.uint32)), "c": pack(np.concatenate(opens).astype(np.uint8)), "d": pack(uniq[order])}]
            edge = _runs(shard[order])
            for x, y in zip(edge[:-1], edge[1:], strict=True):
                mine = order[x:y]
                out.append({"block": name, "kind": COUNT, "shard": int(shard[mine[0]]), "n": y - x, "a": pack(uniq[mine]), "b": pack(counts[mine].astype(np.uint8))})
            yield pa.RecordBatch.from_pylist(out, schema=ARROW)

    return texts.mapInArrow(run, SCHEMA)


def _count_documents(table: pa.Table) -> pa.Table:
    """Which of the blocks' shingles more than RARE documents have."""
    rows = _rows(table)
    uniq, which = np.unique(np.concatenate([unpack(r["a"], r["n"], np.uint64) for r in rows]), return_inverse=True)
    total = np.bincount(which, weights=np.concatenate([unpack(r["b"], r["n"], np.uint8) for r in rows]), minlength=len(uniq))
    frequent, at, out = (total > RARE)[which], 0, []
    for r in rows:
        mine = frequent[at : at + r["n"]]
        at += r["n"]
        if mine.any():
            out.append({"block": r["block"], "kind": FREQUENT, "shard": r["shard"], "n": r["n"], "a": pack(mine.astype(np.uint8))})
    return pa.Table.from_pylist(out, schema=ARROW)


def _windows_again(table: pa.Table, hashes: int, length: int, shards: int, most: int) -> pa.Table:
    """Windows and requests of a block of segments, rare shingles first."""
    rows = _rows(table)
    head = next(r for r in rows if r["kind"] == SEGMENTS)
    segments = unpack(head["a"], 3 * head["n"], np.int64).reshape(-1, 3)
    size = int(segments[:, 2].sum())
    uniq, which = unpack(head["d"], head["m"], np.uint64), unpack(head["b"], size, np.uint32).astype(np.int64)
    is_open, frequent = unpack(head["c"], size, np.uint8), np.zeros(head["m"], bool)
    shard = (uniq % np.uint64(shards)).astype(np.int64)
    for r in rows:
        if r["kind"] == FREQUENT:
            at = int(np.searchsorted(shard, r["shard"]))
            frequent[at : at + r["n"]] = unpack(r["a"], r["n"], np.uint8) > 0
    ends = np.concatenate(([0], np.cumsum(segments[:, 2])))
    key, segment, windows = _all_windows(uniq[which], ends, hashes, length, frequent[which])
    before = np.concatenate(([0], np.cumsum(is_open)))
    mid = windows[2] + ends[segment]
    begin, end = np.maximum(windows[0] + ends[segment], mid - length + 1), np.minimum(windows[1] + ends[segment], mid + length - 1) + 1
    opened = before[end] - before[begin] > 0
    windows[:3] += segments[segment, 1]
    doc_ids, text = np.unique(segments[:, 0], return_inverse=True)
    return pa.Table.from_pylist(_ask_owners(head["block"], shards, most, key, text[segment], np.concatenate((windows, opened[None].astype(np.int64))), doc_ids), schema=ARROW)


def _found_in(x: np.ndarray, sorted_values: np.ndarray) -> np.ndarray:
    """Which of ``x`` are among the sorted values; a search in them takes a tenth of the time of ``np.isin`` on texts of some hundred shingles."""
    at = np.searchsorted(sorted_values, x)
    return sorted_values[np.minimum(at, len(sorted_values) - 1)] == x


def matching_spans(earlier: np.ndarray, later: np.ndarray, width: int, passage: int, similarity: float) -> list[tuple[int, int, float]]:
    """(first shingle, shingles, share found) of the passages of ``later`` whose shingles occur in ``earlier``."""
    if not len(later) or not len(earlier):
        return []
    hit = _found_in(later, np.sort(earlier))
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    runs = list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))
    least = 2 * similarity / (1 + similarity)
    # Neighbouring runs are joined, the nearest first, while enough of the whole is found.
    merged: list[list[int]] = []
    for a, b in runs:
        merged.append([a, b, b - a])
        while len(merged) > 1:
            (a1, _, n1), (_, b2, n2) = merged[-2], merged[-1]
            if n1 + n2 < least * (b2 - a1):
                break
            merged[-2:] = [[a1, b2, n1 + n2]]
    # A changed word near an end leaves up to width - 1 shingles there unfound: short spans reach for them, as far as enough of the whole is found.
    length, out = passage - width + 1, []
    for i, (a, b, n) in enumerate(merged):
        left = min(width - 1, a - (merged[i - 1][1] if i else 0), max(0, length - (b - a)))
        right = min(width - 1, (merged[i + 1][0] if i + 1 < len(merged) else len(later)) - b, max(0, length - (b - a) - left))
        k = b - a + left + right
        if k >= length and n >= least * k:
            out.append((a - left, k, n / k))
    return [y for x in out for y in _in_one_place(earlier, later, x, width, passage, similarity)]


def _in_one_place(earlier: np.ndarray, later: np.ndarray, span: tuple[int, int, float], width: int, passage: int, similarity: float) -> list[tuple[int, int, float]]:
    """``span``, if enough of its shingles stand within as many of the earlier document; else the parts of it of which that holds."""
    a, k, _ = span
    mine = later[a : a + k]
    place = np.flatnonzero(_found_in(earlier, known := distinct(mine)))
    count = np.searchsorted(place, place + k) - np.arange(len(place))
    best = int(np.argmax(count))
    if count[best] >= 2 * similarity / (1 + similarity) * len(known):
        return [span]
    # The part that stands around the fullest place, then what is left on either side.
    part = earlier[max(0, int(place[best]) - width) : int(place[best]) + k + width]
    if len(part) >= len(earlier):
        return [span]
    found = matching_spans(part, mine, width, passage, similarity)
    out, at = [], 0
    for b, n, share in [*found, (k, 0, 0.0)]:
        rest = mine[at:b]
        if len(found) and len(rest) >= passage - width + 1:
            out += [(at + x, m, s) for x, m, s in matching_spans(earlier, rest, width, passage, similarity)]
        if n:
            out.append((b, n, share))
        at = b + n
    return [(a + x, n, share) for x, n, share in out]


def _placed(blocks_of, hashes: int, length: int, shards: int, most: int) -> DataFrame:
    return blocks_of.applyInArrow(lambda t: _windows_again(t, hashes, length, shards, most), SCHEMA)


def duplicate_passages(docs: DataFrame, width: int = WIDTH, passage: int = PASSAGE, similarity: float = SIMILARITY, hashes: int = HASHES, hits: int = MIN_HITS) -> DataFrame:
    """(doc_id, text_key, first_word, n_words, source_id, similarity): passages that nearly occur in an earlier document."""
    spark = docs.sparkSession
    shards = shards_for(text_bytes(docs), SHARD_TEXT_BYTES)
    made = materialize(spark, _windows(docs, width, passage, hashes, shards), "windows", "kind")
    found = _round(made, "candidates", 1, 1, hits, passage - width + 1)
    pairs = materialize(spark, _pairs(found), "pairs")
    spans = materialize(spark, _verified(docs, pairs, width, passage, similarity), "spans")
    lead = LEADERS
    while True:
        regions = materialize(spark, _regions(found, spans, width, passage, shards), "regions")
        discard(found)
        n_open = regions.where("size(open_begins) > 0").count()
        if not n_open:
            return spans
        made = materialize(spark, _segments(docs, regions, width, shards), "segments", "kind")
        flags = made.where(f"kind = {COUNT}").groupBy("shard").applyInArrow(_count_documents, SCHEMA)
        blocks_of = made.where(f"kind = {SEGMENTS}").unionByName(flags).groupBy("block")
        most = max(RARE, lead)
        again = materialize(spark, _placed(blocks_of, hashes, passage - width + 1, shards, most), "windows", "kind")
        discard(made)
        found = _round(again, "candidates", most, lead, hits, passage - width + 1)
        new = materialize(spark, _pairs(found).join(pairs.hint("merge"), ["a", "b"], "left_anti"), "pairs")
        n_new = new.count()
        if n_new:
            # No pair is in two rounds, so no row is either.
            spans, pairs = spans.unionByName(materialize(spark, _verified(docs, new, width, passage, similarity), "spans")), pairs.unionByName(new)
        lead = more_leaders(lead, n_new, n_open)


def more_leaders(lead: int, n_new: int, n_open: int) -> int:
    """How many of the least documents a round meets after one that met ``lead`` and made ``n_new`` pairs for ``n_open`` open documents.

    Four times as many, so that windows settled on the way bring no further
    pairs; after a round of fewer pairs than open documents sixteen times as many.
    """
    return (4 if n_new > n_open else 16) * lead


def _verified(docs: DataFrame, pairs: DataFrame, width: int, passage: int, similarity: float) -> DataFrame:
    """The passages of documents b of ``pairs`` that nearly occur in their documents a."""
    spark = docs.sparkSession
    wanted = materialize(spark, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "wanted")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("id"), "text").join(_small(wanted), "id", "left_semi").select("id", F.xxhash64("text").alias("text_key"), "text")

    def to_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", BLOCK_BYTES):
            codes, offsets, words = words_of(block.column("text"))
            h, ends = shingle_hashes(codes, offsets, word_hashes(words), width)
            low = h.astype(np.uint32)
            yield pa.RecordBatch.from_arrays([block.column("id"), block.column("text_key"), pa.array([low[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], names=["id", "text_key", "items"])

    # Each text is cut once, however many pairs it is in.
    sets = materialize(spark, texts.mapInArrow(to_shingles, "id bigint, text_key bigint, items binary").distinct(), "shingles")
    # Sort-merge joins at any size: the plan is the same for small and large inputs.
    later, earlier = sets.select(F.col("id").alias("b"), "text_key", F.col("items").alias("items_b")), sets.select(F.col("id").alias("a"), F.col("items").alias("items_a"))
    rows = pairs.join(later.hint("merge"), "b").join(earlier.hint("merge"), "a")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b, key, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text_key", "items_a", "items_b")), strict=True):
                spans = matching_spans(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32), width, passage, similarity)
                out += [{"doc_id": b, "text_key": key, "first_word": s, "n_words": k + width - 1, "source_id": a, "similarity": share / (2 - share)} for s, k, share in spans]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("source_id", pa.int64()), ("similarity", pa.float64())]))

    return rows.mapInArrow(verify, "doc_id bigint, text_key bigint, first_word bigint, n_words bigint, source_id bigint, similarity double").distinct()


def without_passages(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with the words of ``spans`` taken out of their texts; documents left without a word go.

    What stays keeps its white space; ``n_chars`` is counted anew where there is
    such a column.
    """
    span_id, span_key, span_list = (fresh(docs, c) for c in ("span_id", "span_key", "span_list"))
    places = spans.groupBy(F.col("doc_id").alias(span_id), F.col("text_key").alias(span_key)).agg(F.sort_array(F.collect_set(F.struct("first_word", "n_words"))).alias(span_list))  # as many as fit in one text
    joined = docs.join(places.hint("merge"), (F.col("doc_id") == F.col(span_id)) & (F.xxhash64("text") == F.col(span_key)), "left").drop(span_id, span_key)
    names = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        word = regex.compile(r"[^\x20\x09-\x0D]+")
        for b in batches:
            texts, lists = b.column("text").to_pylist(), b.column(span_list).to_pylist()
            keep = []
            for i, (text, spans) in enumerate(zip(texts, lists, strict=True)):
                if spans:
                    at = [m.span() for m in word.finditer(text)]
                    out, pos, last = [], 0, 0
                    for s in spans:
                        first, end = max(s["first_word"], last), s["first_word"] + s["n_words"]
                        if end > first:
                            out.append(text[pos : at[first][0]])
                            pos, last = at[end - 1][1], end
                    texts[i] = "".join([*out, text[pos:]])
                    if not texts[i].strip("\x20\t\n\x0b\x0c\r"):
                        continue
                keep.append(i)
            table = pa.Table.from_batches([b]).select(names)
            changed = pa.array(texts, pa.string()).cast(table.schema.field("text").type)
            table = table.set_column(names.index("text"), table.schema.field("text"), changed)
            if "n_chars" in names:
                field = table.schema.field("n_chars")
                counts = [n if not s or t is None else len(t) for n, s, t in zip(b.column("n_chars").to_pylist(), lists, texts, strict=True)]
                table = table.set_column(names.index("n_chars"), field, pa.array(counts, field.type))
            yield from table.take(pa.array(keep, pa.int64())).to_batches()

    return joined.mapInArrow(cut, docs.schema)
