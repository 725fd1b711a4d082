"""Exact repeated byte strings by merging Burrows-Wheeler transforms.

Removes each byte that lies in a LENGTH-byte string which also starts in a
document with a smaller ``doc_id``.  Strings are judged on the input.

*Dealing the suffixes.*  Every LENGTH-byte string contains the least hash of its
GRAM-byte grams (winnowing), so equal strings share that gram.  Blocks learn
through an exchange which of these grams more than one document has; only
around those can a string repeat.  The *context* of a gram, all bytes of the
strings that may have chosen it, goes to the shard of the gram; equal contexts
are one, with the least ``doc_id`` that has it.  So every string that occurs
twice has all its occurrences in one shard, and no two shards need to meet.

*Transforms.*  Strings with different grams differ, so a gram with one context
has nothing to merge.  For the other contexts, those of each block of the input
are one text shard and have a Burrows-Wheeler transform of their own: for the
suffixes in sorted order, the symbol before each.  A symbol here is STEP bytes
(as its rank), so that a pass refines by STEP bytes; a pass holds only the
suffixes from which the remaining passes lead to a start of a string.

*Merge.*  The text shards' transforms are merged as Holt and McMillan do:
starting from any interleave, a pass reads the symbols from the transforms in
the order of the interleave and deals the interleave stably by symbol; after
passes over LENGTH bytes it is sorted by prefixes of that length.  The common
prefix of neighbours follows from the symbols that the passes brought; runs with
LENGTH bytes in common are the repeated intervals.  No suffix of the merged
collection is compared or sorted again.

*Result.*  The least ``doc_id`` of an interval goes to all its members, back to
the contexts, and to the blocks, which mark and cut the bytes.

Edge cases: a null text is empty; a document with a null ``doc_id`` has no
smaller or larger ones, keeps all its bytes and takes none from others; rows
that share a ``doc_id`` take nothing from each other; texts shorter than LENGTH
keep all; very long texts are a block of their own; an empty table gives an
empty result; other columns are ignored, whatever their names.

The blocks are formed several times from the same scan, whose cut into input
tasks is pinned; answers carry a checksum of the block's keys, so a reading that
differs ends the job.  ``docs`` that are not a plain scan are written to shared
storage first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _exchange as ex
from ._common import GOLD, blocks, materialize, mix, pack, pin_splits, shards_for, text_bytes, unpack
from .substring_dedup import window_minima

LENGTH = 50
GRAM = 16
STEP = 8
CHUNK = 1 << 16  # a multiple of what window_minima takes places modulo
RUN = 2048  # contexts merged at a time, within a gram's
BLOCK_BYTES = 4 << 20
SHARD_TEXT_BYTES = 4 << 20
BEFORE = LENGTH - GRAM
WIDTH = 2 * LENGTH - GRAM  # of a context
PADDED = -(-(WIDTH + 1) // STEP) * STEP
REST = LENGTH % STEP  # bytes of the first, short pass
SHORT = np.uint64(64 - 8 * REST)
STARTS = WIDTH - LENGTH + 1  # strings in a full context
NONE = np.iinfo(np.int64).max


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one big-endian number (zeros after the end)."""
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[: len(data)] = data
    out = np.empty(len(data), np.uint64)
    for k in range(8):
        n = len(out[k::8])
        out[k::8] = np.frombuffer(padded.data, ">u8", count=n, offset=k)
    return out


def fingerprints(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the chosen grams of texts given one after another.

    Runs of CHUNK windows are done at a time, so that the arrays stay in cache.
    """
    window = LENGTH - GRAM + 1
    places, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for lo in range(0, max(0, len(data) - LENGTH + 1), CHUNK):
        part = data[lo : lo + CHUNK + LENGTH - 1]
        x = words_at(part)
        n = len(part) - GRAM + 1
        h = mix(mix(x[:n] + GOLD) ^ x[8 : 8 + n])
        found = window_minima(h, window)
        places.append(found + lo)
        hashes.append(h[found])
    place, h = np.concatenate(places), np.concatenate(hashes)
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1]))) if len(place) else np.zeros(0, np.int64)
    place, h = place[first], h[first]
    text = np.searchsorted(ends, place, side="right") - 1
    inside = place + GRAM <= ends[text + 1]
    return place[inside], h[inside]


def context_bounds(place: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the contexts of grams begin and end, within their texts."""
    text = np.searchsorted(ends, place, side="right") - 1
    return np.maximum(place - BEFORE, ends[text]), np.minimum(place + GRAM + BEFORE, ends[text + 1])


def stable_order(ranks: np.ndarray) -> np.ndarray:
    """Stable order of 32-bit ranks: place and rank share one number, so a plain sort does it."""
    return (np.sort((ranks.astype(np.uint64) << np.uint64(32)) | np.arange(len(ranks), dtype=np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.int64)


class Transforms:
    """The suffixes of some text shards' contexts, each shard's in sorted order, pass by pass, and the symbols before them.

    A string starts at one of STARTS places, so the pass that is to be refined
    by k more symbols needs the suffixes from k * STEP places later only.  The
    shards' sequences stand one after another and are never mixed here.
    """

    def __init__(self, ranks: np.ndarray, short: np.ndarray, shard: np.ndarray):
        """``ranks`` and ``short``: symbols of STEP and of REST bytes by context and place, as ranks; ``shard``: rising numbers."""
        m = len(ranks)
        starts = np.arange(STARTS)
        row = np.repeat(np.arange(m), STARTS)
        self.shard = np.repeat(shard, STARTS).astype(np.uint32)
        span = np.uint64(max(int(ranks.max(initial=0)), int(short.max(initial=0))) + 1)
        fits = int(span) * (int(self.shard.max(initial=0)) + 1) < 1 << 32

        def within(symbols: np.ndarray) -> np.ndarray:
            if fits:
                return stable_order((self.shard.astype(np.uint64) * span + symbols).astype(np.uint32))
            order = stable_order(symbols)
            return order[stable_order(self.shard[order])]

        # Pass 0 sorts by the last, short symbol; the suffixes begin there.
        self.first = short[:, LENGTH - REST + starts].reshape(-1)
        order = within(self.first)
        self.transform = []
        for step in range(LENGTH // STEP):
            at = LENGTH - REST - STEP * (step + 1)
            before = ranks[:, at + starts].reshape(-1)
            self.transform.append(before[order])
            order = order[within(self.transform[-1])]
        self.row, self.start = row[order], order % STARTS
        self.ranks = ranks

    def leading(self, step: int) -> np.ndarray:
        """The symbol that pass ``step`` brought, of each string in its shard's final order."""
        return self.ranks[self.row, self.start + LENGTH - REST - STEP * (step + 1)]


def merge(t: Transforms) -> tuple[np.ndarray, np.ndarray]:
    """The interleave of the shards' suffixes, sorted by LENGTH bytes, and the common prefix of each with the one before.

    A pass reads the next symbol of each shard in the order of the interleave.
    Common prefixes are known to whole symbols: a boundary that the pass over
    the symbols from ``LENGTH - n`` bytes on adds has a prefix below n bytes.
    """
    z = t.shard
    new = np.zeros(len(z), bool)
    new[:1] = True
    for step in range(-1, LENGTH // STEP):
        symbols = np.empty(len(z), np.uint32)
        symbols[stable_order(z)] = t.first if step < 0 else t.transform[step]
        group = np.cumsum(new)
        order = stable_order(symbols)
        z = z[order]
        s, g = symbols[order], group[order]
        new = np.concatenate(([True], (s[1:] != s[:-1]) | (g[1:] != g[:-1])))[: len(z)]
    return z, _prefixes(t, z, new)


def _prefixes(t: Transforms, z: np.ndarray, new: np.ndarray) -> np.ndarray:
    """LENGTH within an interval of equal strings; else the bytes that are known to be equal, by whole symbols from the front."""
    lcp = np.where(new, 0, LENGTH)
    if not len(z):
        return lcp
    # The last passes brought the first symbols: those in front of the sorted suffixes tell where neighbours part.
    place = np.empty(len(z), np.int64)
    place[stable_order(z)] = np.arange(len(z))
    same = np.ones(len(z), bool)
    for step in range(LENGTH // STEP - 1, -1, -1):
        symbol = t.leading(step)[place]
        same[1:] &= symbol[1:] == symbol[:-1]
        same[0] = False
        lcp = np.where(new & same, lcp + STEP, lcp)
    return lcp


def _ranked(symbols: np.ndarray) -> np.ndarray:
    return np.unique(symbols, return_inverse=True)[1].reshape(symbols.shape).astype(np.uint32)


def repeated(rows: np.ndarray, sizes: np.ndarray, owners: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """For each context and start, the least owner of the string there (NONE past its end); ``shard``: the text shard that the context is from."""
    count = len(rows)
    out = np.full((count, STARTS), NONE)
    if not count:
        return out
    by = np.argsort(shard, kind="stable")
    symbols = words_at(np.pad(rows[by], ((0, 0), (0, STEP))).reshape(-1)).reshape(count, -1)[:, :PADDED]
    ranks, short = _ranked(symbols[:, : WIDTH - STEP + 1]), _ranked(symbols >> SHORT)
    t = Transforms(ranks, short, np.unique(shard[by], return_inverse=True)[1])
    z, lcp = merge(t)
    # Rank by rank, which string of which context stands there.
    row, start = np.empty(len(z), np.int64), np.empty(len(z), np.int64)
    place = stable_order(z)
    row[place], start[place] = by[t.row], t.start
    whole = start + LENGTH <= sizes[row]
    value = np.where(whole, owners[row], NONE)
    new = lcp < LENGTH
    begins = np.flatnonzero(new)
    least = np.minimum.reduceat(value, begins)[np.cumsum(new) - 1]
    out[row[whole], start[whole]] = least[whole]
    return out


def by_gram(rows: np.ndarray, sizes: np.ndarray, owners: np.ndarray, grams: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """:func:`repeated` of contexts that may be equal, with the hashes of their grams.

    Equal contexts are one, with the least owner.  A gram whose contexts are all
    equal has nothing to merge: its strings occur where the context does.
    """
    digest, words = grams.copy(), np.ascontiguousarray(rows).view(np.uint64)
    for k in range(PADDED // 8):
        digest = mix(digest + GOLD ^ words[:, k])
    order = np.argsort(digest)
    same = (digest[order][1:] == digest[order][:-1]) & (words[order][1:] == words[order][:-1]).all(axis=1)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(np.concatenate(([True], ~same))) - 1
    first = order[np.concatenate(([True], ~same))]
    least = np.full(len(first), NONE)
    np.minimum.at(least, number, owners)
    rows, sizes, shard = rows[first], sizes[first], shard[first]
    _, which, count = np.unique(grams[first], return_inverse=True, return_counts=True)
    several = count[which] > 1
    starts = np.arange(STARTS) + LENGTH <= sizes[:, None]
    found = np.where(starts, least[:, None], NONE)
    # Grams are merged in runs of about RUN contexts, so that the arrays stay in cache.
    todo = np.flatnonzero(several)
    todo = todo[np.argsort(which[todo], kind="stable")]
    new = np.flatnonzero(np.concatenate(([True], which[todo][1:] != which[todo][:-1]))) if len(todo) else np.zeros(0, np.int64)
    cuts = [0, *new[np.flatnonzero(np.diff(new // RUN)) + 1].tolist(), len(todo)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        mine = todo[a:b]
        found[mine] = repeated(rows[mine], sizes[mine], least[mine], shard[mine])
    return found[number]


SCHEMA = ex.SCHEMA
CONTEXTS, FOUND = 4, 5


class _Block:
    """The bytes of a block and its chosen grams."""

    def __init__(self, block: pa.RecordBatch, shards: int):
        texts = [t.encode() if t else b"" for t in block.column("text").to_pylist()]
        self.doc_ids = block.column("doc_id").to_pylist()
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.ends = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        place, h = fingerprints(self.data, self.ends)
        text = np.searchsorted(self.ends, place, side="right") - 1
        named = np.array([d is not None for d in self.doc_ids])[text] if len(text) else np.zeros(0, bool)
        self.place, h, self.text = place[named], h[named], text[named]
        self.owner = np.array([d or 0 for d in self.doc_ids], np.int64)[self.text] if len(self.text) else np.zeros(0, np.int64)
        self.keys, self.key_place, self.bounds = ex.distinct_keys(h, shards)

    def contexts(self, shared: np.ndarray) -> tuple[np.ndarray, ...]:
        """Occurrences of shared grams, their context's number, and of the contexts: rows, sizes, least owners, shards, grams."""
        at = np.flatnonzero(shared[self.key_place]) if len(self.key_place) else np.zeros(0, np.int64)
        begin, end = context_bounds(self.place[at], self.ends)
        long = end - begin >= LENGTH
        at, begin, end = at[long], begin[long], end[long]
        n = end - begin
        padded = np.concatenate((self.data, np.zeros(PADDED, np.uint8)))
        rows = np.lib.stride_tricks.sliding_window_view(padded, PADDED)[begin]
        rows[:, WIDTH:] = 0
        cut = np.flatnonzero(n < WIDTH)
        rows[cut] *= np.arange(PADDED) < n[cut, None]
        grams = self.keys[self.key_place[at]]
        digest, words = grams ^ n.astype(np.uint64), rows.view(np.uint64)
        for k in range(PADDED // 8):
            digest = mix(digest + GOLD ^ words[:, k])
        shard = np.searchsorted(self.bounds, self.key_place[at], side="right") - 1
        uniq, first, number = np.unique(digest, return_index=True, return_inverse=True)
        owners = np.full(len(uniq), NONE)
        np.minimum.at(owners, number, self.owner[at])
        # Contexts in the order of their shards.
        order = np.argsort(shard[first], kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        first = first[order]
        return at, rank[number.reshape(-1)], rows[first], n[first], owners[order], shard[first], grams[first]


def _merge_shard(table: pa.Table) -> pa.Table:
    asks = [dict(zip(ex.NAMES, r, strict=True)) for r in zip(*(table.column(c).to_pylist() for c in ex.NAMES), strict=True)]
    data = [np.frombuffer(pa.decompress(r["keys"], decompressed_size=r["n"] * (PADDED + 8), codec="zstd", asbytes=True), np.uint8) for r in asks]
    rows = np.concatenate([x[: r["n"] * PADDED].reshape(-1, PADDED) for x, r in zip(data, asks, strict=True)])
    grams = np.concatenate([x[r["n"] * PADDED :].view(np.uint64) for x, r in zip(data, asks, strict=True)])
    owners = np.concatenate([unpack(r["owners"], r["n"], np.int64) for r in asks])
    sizes = np.concatenate([unpack(r["flags"], r["n"], np.uint8) for r in asks]).astype(np.int64)
    found = by_gram(rows, sizes, owners, grams, np.repeat(np.arange(len(asks)), [r["n"] for r in asks]))
    out, at = [], 0
    for r in asks:
        out.append({"block": r["block"], "kind": FOUND, "shard": r["shard"], "n": r["n"], "keys": pack(found[at : at + r["n"]].reshape(-1)), "owners": None, "flags": None})
        at += r["n"]
    return pa.Table.from_pylist(out, schema=ex.ARROW)


def repeated_bytes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of all documents; ``kept`` has the bytes that stay."""
    spark = docs.sparkSession
    pin_splits(spark)
    shards = shards_for(text_bytes(docs), SHARD_TEXT_BYTES)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    if "Exchange" in texts._jdf.queryExecution().executedPlan().toString():
        texts = materialize(spark, texts, "texts")

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for number, block in enumerate(blocks(batches, "text", BLOCK_BYTES)):
            yield (task << 32) | number, block

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, block in named(batches):
            b = _Block(block, shards)
            yield pa.RecordBatch.from_pylist(ex.asked(name, b.keys, b.key_place, b.bounds, b.owner), schema=ex.ARROW)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, block in named(batches):
            sink = pa.BufferOutputStream()
            raw = pa.Table.from_batches([block]).combine_chunks()
            with pa.ipc.new_stream(sink, raw.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(raw)
            yield pa.RecordBatch.from_pylist([{"block": name, "kind": 0, "shard": -1, "n": 0, "keys": sink.getvalue().to_pybytes()}], schema=ex.ARROW)

    def opened(table: pa.Table) -> tuple[list[dict], _Block]:
        rows = [dict(zip(ex.NAMES, r, strict=True)) for r in zip(*(table.column(c).to_pylist() for c in ex.NAMES), strict=True)]
        head = next(r for r in rows if r["kind"] == 0)
        return rows, _Block(pa.ipc.open_stream(head["keys"]).read_all().combine_chunks().to_batches()[0], shards)

    def shared_of(rows: list[dict], b: _Block) -> np.ndarray:
        check = ex.checksum(b.keys)
        for r in rows:
            if r["kind"] == ex.ANSWER and r["sum"] != check:
                raise RuntimeError("the input was read in another order the second time")
        return ex.answers(rows, len(b.keys), b.bounds)[0]

    def gather(table: pa.Table) -> pa.Table:
        rows, b = opened(table)
        _, _, contexts, sizes, owners, shard, grams = b.contexts(shared_of(rows, b))
        name, out = rows[0]["block"], []
        for s in np.unique(shard):
            mine = shard == s
            out.append({"block": name, "kind": CONTEXTS, "shard": int(s), "n": int(mine.sum()), "keys": pa.compress(contexts[mine].tobytes() + grams[mine].tobytes(), codec="zstd", asbytes=True), "owners": pack(owners[mine]), "flags": pack(sizes[mine].astype(np.uint8))})
        return pa.Table.from_pylist(out, schema=ex.ARROW)

    def finish(table: pa.Table) -> pa.Table:
        rows, b = opened(table)
        at, number, contexts, _, _, shard, _ = b.contexts(shared_of(rows, b))
        found = np.full((len(contexts), STARTS), NONE)
        for r in rows:
            if r["kind"] == FOUND:
                mine = np.flatnonzero(shard == r["shard"])
                found[mine] = unpack(r["keys"], r["n"] * STARTS, np.int64).reshape(-1, STARTS)
        edge = np.zeros(len(b.data) + 1, np.int32)
        step = 1 << 16
        for lo in range(0, len(at), step):
            part = at[lo : lo + step]
            hit, start = np.nonzero(found[number[lo : lo + step]] < b.owner[part][:, None])
            begin, _ = context_bounds(b.place[part], b.ends)
            place = np.unique(begin[hit] + start)
            np.add.at(edge, place, 1)
            np.add.at(edge, place + LENGTH, -1)
        gone = np.cumsum(edge[:-1]) > 0
        first = gone & ~np.concatenate(([False], gone[:-1])) if len(gone) else gone
        opens = b.ends[:-1][np.diff(b.ends) > 0]
        first[opens] = gone[opens]
        removed, spans = (np.add.reduceat(np.append(x, 0).astype(np.int64), np.minimum(b.ends[:-1], len(x))) * (np.diff(b.ends) > 0) for x in (gone, first))
        kept = [b.data[a:e][~gone[a:e]].tobytes() for a, e in zip(b.ends[:-1], b.ends[1:], strict=True)]
        return pa.table(
            {
                "doc_id": pa.array(b.doc_ids, pa.int64()),
                "n_bytes": pa.array(np.diff(b.ends)),
                "n_removed": pa.array(removed),
                "n_spans": pa.array(spans),
                "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
                "kept": pa.array(kept, pa.binary()),
            }
        )

    found = materialize(spark, ex.exchanged(texts.mapInArrow(ask, SCHEMA)), "shared")
    contexts = texts.mapInArrow(again, SCHEMA).unionByName(found).groupBy("block").applyInArrow(gather, SCHEMA)
    merged = materialize(spark, contexts.groupBy("shard").applyInArrow(_merge_shard, SCHEMA), "repeats")
    both = texts.mapInArrow(again, SCHEMA).unionByName(found).unionByName(merged)
    return both.groupBy("block").applyInArrow(finish, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
