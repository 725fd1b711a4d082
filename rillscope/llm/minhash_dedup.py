"""Near-duplicate documents by DartMinHash signatures and banded joining.

*Signatures.*  A document is a weighted set of word shingles.  Each element
owns an area of weight x rank, cut into regions of doubling weight.  Darts fall
on a region as a Poisson process in rank whose gaps, weight positions and
coordinates come from hashes of (element, region, number), so any two documents
see the same darts.  A document throws the darts of its elements up to a rank
at which about k ln k + 2k land below its weights, keeps the earliest dart of
each of k coordinates, and doubles the rank if a coordinate is still empty.
Two documents agree in a coordinate with the probability of their weighted
Jaccard similarity.  The work is about k ln k darts per document plus one hash
per element, not k hashes per element.

*Candidates.*  ``rows`` coordinates form a band; documents that share a band
are in one bucket.  A bucket first links all its members to its least one
(linear in its size).  When the links that hold are known, buckets that still
have members of several components compare those outside the bucket's largest
component with all others; so every pair that shares a bucket is verified,
already in one component, or told apart by 512 further bits of signature (a
pair at the threshold is so with a probability of 4e-6) or by 512 parities of
its shingles, which never differ in more places than the sets do.  A pair is
looked at in the least of the buckets it shares.  Nothing is capped.

*Verification.*  Links are kept if the exact similarity of the shingle sets
reaches the threshold.  With 40 bands of 6 a pair of similarity 0.8 shares no
bucket with a probability of 5e-6.

Equal texts are one class from the start (by a 128-bit digest); only their
least ``doc_id`` is signed, so copies are never expanded into pairs.

Edge cases: a null text is never a duplicate; texts without words are
duplicates only if equal; texts with fewer words than a shingle have one
shingle of all their words; rows with a null ``doc_id`` are returned with a null
class; repeated rows are returned once each, and different texts under one
``doc_id`` are one class; empty tables give an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import GOLD, blocks, hash_words, materialize, mix, shingle_hashes, words_of
from .components import connected_components

WIDTH = 5
THRESHOLD = 0.8
BANDS = 40
ROWS = 6
BITS = 512
BLOCK_BYTES = 4 << 20
MOST_HOT = 4096
MASK = (1 << 64) - 1
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def _unit(h: np.ndarray) -> np.ndarray:
    """Uniform numbers in (0, 1]."""
    return ((h >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53


def _throw(best: np.ndarray, doc: np.ndarray, seed: np.ndarray, weight: np.ndarray, low: float, width: float, limit: np.ndarray) -> None:
    """Throw the darts of one weight region; ``best`` (documents x k) keeps the earliest of each coordinate."""
    k = np.uint64(best.shape[1])
    flat = best.reshape(-1)
    rank = np.zeros(len(doc))
    number = 0
    seed = mix(seed + np.uint64(int(low * 2 + 1) * int(GOLD) & MASK))
    while len(doc):
        number += 1
        h = mix(seed + np.uint64(number * int(GOLD) & MASK))
        rank = rank - np.log(_unit(h)) / width
        go = rank <= limit[doc]
        if not go.all():
            doc, seed, weight, rank, h = doc[go], seed[go], weight[go], rank[go], h[go]
        if not len(doc):
            return
        g = mix(h ^ GOLD)
        slot = doc * int(k) + ((g >> np.uint64(32)) % k).astype(np.int64)
        value = (rank.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (g & np.uint64(0xFFFFFFFF))
        if low or (weight < width).any():
            inside = low + _unit(mix(g)) * width <= weight
            slot, value = slot[inside], value[inside]
        np.minimum.at(flat, slot, value)


def dart_minhash(elements: np.ndarray, weights: np.ndarray, ends: np.ndarray, k: int) -> np.ndarray:
    """Signatures (documents x k, 32-bit) of weighted sets given one after another.

    ``ends`` has the boundaries, one more than there are documents.  Documents
    without elements get zeros.
    """
    n = len(ends) - 1
    sizes = np.diff(ends)
    owner = np.repeat(np.arange(n), sizes)
    best = np.full((n, k), EMPTY, dtype=np.uint64)
    total = np.bincount(owner, weights=weights, minlength=n) if len(owner) else np.zeros(n)
    limit = (k * np.log(k) + 2 * k) / np.maximum(total, 1e-300)
    todo = sizes > 0
    top = float(weights.max()) if len(weights) else 0.0
    while todo.any():
        mine = todo[owner]
        low, width = 0.0, 1.0
        while low < top:
            here = mine & (weights > low)
            _throw(best, owner[here], elements[here], weights[here], low, width, limit)
            low, width = low + width, low + width
        todo = (best == EMPTY).any(axis=1) & todo
        limit = np.where(todo, limit * 2, limit)
    return np.where(best == EMPTY, np.uint64(0), best & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """64-bit keys (documents x bands) of the bands of signatures."""
    parts = signatures[:, : bands * rows].reshape(len(signatures), bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * GOLD, parts.shape[:2]).copy()
    for r in range(rows):
        key = mix(key + GOLD + parts[:, :, r])
    return key


def _sets(texts: pa.Array, width: int, counts: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, their weights, and the boundaries."""
    codes, offsets, words = words_of(texts)
    found, ends = shingle_hashes(codes, offsets, hash_words(words), width)
    parts = [np.unique(found[a:b], return_counts=True) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    sizes = [len(p[0]) for p in parts]
    elements = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint64)
    weights = (np.concatenate([p[1] for p in parts]) if parts else np.zeros(0)).astype(np.float64)
    return elements, weights if counts else np.ones(len(elements)), np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)


def sketches(docs: DataFrame, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS, counts: bool = False) -> DataFrame:
    """doc_id, digest of the text (null for a null text), number of shingles and band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", BLOCK_BYTES):
            texts = block.column("text")
            elements, weights, ends = _sets(texts, width, counts)
            keys = band_keys(dart_minhash(elements, weights, ends, bands * rows), bands, rows).view(np.int64)
            sizes = np.diff(ends)
            has = np.where(sizes > 0, bands, 0)
            at = pa.array(np.concatenate(([0], np.cumsum(has))), pa.int32())
            digest = [None if t is None else xxhash.xxh3_128_digest(t.encode()) for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id").cast(pa.int64()), pa.array(digest, pa.binary()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(at, pa.array(keys[sizes > 0].reshape(-1)))],
                names=["doc_id", "digest", "n", "bands"],
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, digest binary, n bigint, bands array<bigint>")


def shingle_sets(docs: DataFrame, ids: DataFrame, width: int = WIDTH, counts: bool = False) -> DataFrame:
    """(id, items, weights): packed shingle sets of the documents that ``ids`` (column id) names, written once.

    The join is a sort-merge join at any size, so the plan is the same for
    small and large inputs.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("bigint").alias("id"), "text").join(ids.distinct().hint("merge"), "id", "left_semi")

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", BLOCK_BYTES):
            elements, weights, ends = _sets(block.column("text"), width, counts)
            spans = list(zip(ends[:-1], ends[1:], strict=True))
            yield pa.RecordBatch.from_arrays(
                [block.column("id"), pa.array([elements[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([weights[a:b].astype(np.float32).tobytes() if counts else b"" for a, b in spans], pa.binary())],
                names=["id", "items", "weights"],
            )

    sets = materialize(spark, texts.mapInArrow(to_sets, "id bigint, items binary, weights binary"), "sets")
    if sets.count() > sets.select("id").distinct().count():  # repeated rows
        sets = sets.dropDuplicates()
    return sets


def verified(sets: DataFrame, pairs: DataFrame, threshold: float = THRESHOLD, counts: bool = False) -> DataFrame:
    """The pairs (a, b) of ids whose exact (weighted) Jaccard similarity reaches the threshold, with it."""

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, found = [], []
            cols = [b.column(c).to_pylist() for c in ("items", "weights", "items2", "weights2")]
            for i, (x, wx, y, wy) in enumerate(zip(*cols, strict=True)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if counts:
                    _, at, bt = np.intersect1d(x, y, assume_unique=True, return_indices=True)
                    u, v = np.frombuffer(wx, np.float32), np.frombuffer(wy, np.float32)
                    both = float(np.minimum(u[at], v[bt]).sum())
                    either = float(u.sum() + v.sum()) - both
                else:
                    if min(len(x), len(y)) < threshold * max(len(x), len(y)):
                        continue
                    joined = np.concatenate((x, y))
                    joined.sort(kind="stable")
                    both = int(np.count_nonzero(joined[1:] == joined[:-1]))
                    either = len(x) + len(y) - both
                if either and both >= threshold * either:
                    keep.append(i)
                    found.append(both / either)
            yield pa.RecordBatch.from_arrays([b.column("a").take(pa.array(keep, pa.int64())), b.column("b").take(pa.array(keep, pa.int64())), pa.array(found, pa.float64())], names=["a", "b", "similarity"])

    second = sets.select(F.col("id").alias("b"), F.col("items").alias("items2"), F.col("weights").alias("weights2"))
    first = sets.select(F.col("id").alias("a"), "items", "weights")
    joined = pairs.select("a", "b").join(second.hint("merge"), "b").join(first.hint("merge"), "a")
    return joined.mapInArrow(similar, "a bigint, b bigint, similarity double").distinct()


def bit_signatures(sets: DataFrame, counts: bool = False) -> DataFrame:
    """(id, bits, total): one bit of each of BITS coordinates, then BITS parities, in 64-bit words; the set's weight.

    Two sets of similarity s differ in a share of (1 - s) / 2 of the bits.  A
    parity is that of the shingles, each as often as it weighs, that a hash
    sends there; two sets differ in no more of them than in shingles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                b = batch.slice(at, 500)
                items = [np.frombuffer(x, np.uint64) for x in b.column("items").to_pylist()]
                weights = [np.frombuffer(x, np.float32) if counts else np.ones(len(i)) for x, i in zip(b.column("weights").to_pylist(), items, strict=True)]
                ends = np.concatenate(([0], np.cumsum([len(x) for x in items]))).astype(np.int64)
                sig = dart_minhash(np.concatenate(items), np.concatenate(weights).astype(np.float64), ends, BITS)
                words = np.packbits(np.concatenate(((sig & 1).astype(np.uint8), parities(items, weights)), axis=1), axis=1).view(np.int64)
                total = [int(w.sum(dtype=np.float64)) for w in weights]
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(words.tolist(), pa.list_(pa.int64())), pa.array(total, pa.int64())], names=["id", "bits", "total"])

    return sets.mapInArrow(run, "id bigint, bits array<bigint>, total bigint")


def parities(items: list[np.ndarray], weights: list[np.ndarray]) -> np.ndarray:
    """BITS parities (sets x BITS) of sets of shingles with whole weights."""
    out = np.zeros((len(items), BITS), np.uint8)
    for row, item, weight in zip(out, items, weights, strict=True):
        often = weight.astype(np.int64)
        number = np.arange(often.sum()) - np.repeat(np.cumsum(often) - often, often)
        place = mix(np.repeat(item, often) + (number + 1).astype(np.uint64) * GOLD) % np.uint64(BITS)
        row[:] = np.bincount(place.astype(np.int64), minlength=BITS) & 1
    return out


def cross_pairs(placed: DataFrame, sets: DataFrame, threshold: float, counts: bool) -> DataFrame:
    """Pairs (a, b) that share a bucket, lie in different components and may reach the threshold.

    ``placed`` has (key, id, n, least, part): a bucket's members with their
    components.  Members outside a bucket's largest component meet all others
    of the bucket; the join itself keeps only pairs whose bit signatures differ
    no more than those of a pair at the threshold would by 4.5 deviations, and
    whose parities differ in no more places than such a pair's sets.  A pair
    that shares several buckets is kept in that of the least key.
    """
    spark = placed.sparkSession
    sizes = placed.groupBy("key", "part").agg(F.count("*").alias("n_part"))
    major = sizes.groupBy("key").agg(F.max_by("part", F.struct("n_part", "part")).alias("major"), F.count("*").alias("parts")).where("parts > 1").select("key", "major")
    mixed = materialize(spark, placed.join(major, "key"), "mixed")
    words, odds = range(BITS // 64), range(BITS // 64, BITS // 32)
    bits = bit_signatures(sets.join(mixed.select("id").distinct(), "id", "left_semi"), counts)
    keys = mixed.groupBy("id").agg(F.collect_set("key").alias("keys"))  # as many as there are bands
    bits = materialize(spark, bits.join(keys.hint("merge"), "id"), "bits")
    held = [f"w{w}" for w in (*words, *odds)]
    signed = mixed.join(bits, "id").select("key", "id", "n", "least", "part", "major", "total", F.filter("keys", lambda k: k < F.col("key")).alias("before"), *(F.get("bits", F.lit(w)).alias(name) for w, name in enumerate(held)))
    strays = signed.where("part != major").select("key", F.col("id").alias("i"), F.col("n").alias("ni"), F.col("part").alias("pi"), F.col("total").alias("ti"), F.col("before").alias("bi"), "least", *(F.col(w).alias(f"x{w[1:]}") for w in held))
    others = signed.select("key", F.col("id").alias("j"), F.col("n").alias("nj"), F.col("part").alias("pj"), F.col("total").alias("tj"), F.col("before").alias("bj"), (F.col("part") == F.col("major")).alias("in_major"), *held)
    share = (1 - threshold) / 2
    most = int(BITS * share + 4.5 * (BITS * share * (1 - share)) ** 0.5)
    differ = lambda places: sum((F.bit_count(F.col(f"x{w}").bitwiseXOR(F.col(f"w{w}"))) for w in places), F.lit(0))
    fits = F.least("ni", "nj") >= threshold * F.greatest("ni", "nj") if not counts else F.lit(True)
    # At the threshold the weights of what only one set has are this share of both; a little more for rounding.
    apart = (F.col("ti") + F.col("tj")) * ((1 - threshold) / (1 + threshold) + 1e-6)
    close = (differ(words) <= most) & (differ(odds) <= apart) & ~F.arrays_overlap("bi", "bj")
    # Pairs with the bucket's least member have been verified before.
    new = (F.col("pi") != F.col("pj")) & (F.col("in_major") | (F.col("i") < F.col("j"))) & (F.col("i") != F.col("least")) & (F.col("j") != F.col("least"))
    found = strays.join(others, "key").where(new & fits & close)
    return materialize(spark, found.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).distinct(), "pairs")


def near_links(docs: DataFrame, signed: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, counts: bool = False) -> tuple[DataFrame, DataFrame]:
    """Verified links between texts, and (id, component) of what they connect.

    ``signed`` has one row (id, n, bands) per different text.
    """
    spark = docs.sparkSession
    entries = signed.select("id", "n", F.explode("bands").alias("key"))
    # Buckets of one document end here, before anything is joined.
    buckets = entries.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("members")).where("members > 1")
    shared = materialize(spark, entries.join(buckets.select("key", "least"), "key"), "buckets")
    pairs = materialize(spark, shared.where("id != least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    # Every member of a shared bucket is in a pair, so these sets serve both rounds.
    sets = shingle_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")), width, counts)
    links = materialize(spark, verified(sets, pairs, threshold, counts), "verified")
    parts = connected_components(links.select("a", "b"))

    placed = shared.join(parts.withColumnRenamed("component", "part"), "id", "left").select("key", "id", "n", "least", F.coalesce("part", "id").alias("part"))
    rest = cross_pairs(materialize(spark, placed, "placed"), sets, threshold, counts)
    links = links.unionByName(materialize(spark, verified(sets, rest, threshold, counts), "verified"))
    return links, connected_components(links.select("a", "b"))


def _salted(signed: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with a ``salt``, so that the copies of one text are dealt to several tasks.

    Texts with more than a MOST_HOT-th of all rows, at most MOST_HOT by that, are
    few enough to be sent to all tasks.
    """
    most = max(1000, signed.count() // MOST_HOT)
    hot = F.broadcast(materialize(signed.sparkSession, texts.where(F.col("copies") > most).select("digest", F.ceil(F.col("copies") / most).cast("int").alias("salts")), "hot"))
    own = signed.join(hot, "digest", "left").withColumn("salt", F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int")).otherwise(0)).drop("salts")
    other = texts.join(hot, "digest", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    return own, other


def near_duplicates(docs: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, counts: bool = True) -> DataFrame:
    """doc_id, text_id (least doc_id with the same text), class_id (least doc_id of its class) and n_spanning (links of that text that were verified to connect the class).

    ``counts`` weighs shingles by how often they occur; else all weigh one.
    """
    spark = docs.sparkSession
    signed = materialize(spark, sketches(docs, width, bands, rows, counts), "sketches")
    texts = materialize(spark, signed.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("text_id"), F.count("*").alias("copies")), "texts")
    firsts = signed.join(texts.select(F.col("text_id").alias("doc_id"), "digest").hint("merge"), ["doc_id", "digest"], "left_semi").dropDuplicates(["doc_id", "digest"])
    links, parts = near_links(docs, firsts.select(F.col("doc_id").alias("id"), "n", "bands"), width, threshold, counts)
    degree = links.select(F.explode(F.array("a", "b")).alias("text_id")).groupBy("text_id").agg(F.count("*").alias("n_spanning"))
    classes = texts.join(parts.withColumnRenamed("id", "text_id"), "text_id", "left").join(degree, "text_id", "left").select("digest", "copies", "text_id", F.coalesce("component", "text_id").alias("class_id"), F.coalesce("n_spanning", F.lit(0)).alias("n_spanning"))
    own, classes = _salted(signed.select("doc_id", "digest", "n"), materialize(spark, classes, "classes"))
    out = own.join(classes.drop("copies").hint("merge"), ["digest", "salt"], "left")
    alone = F.col("doc_id").isNull() | F.col("digest").isNull()
    return out.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("text_id")).alias("text_id"), F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_spanning", F.lit(0)).cast("bigint").alias("n_spanning"), F.col("n").alias("n_shingles"))
