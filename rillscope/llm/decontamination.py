r"""Benchmark decontamination: BM25 with block-max pruning, then verification.

*Index.*  Document frequencies, the number and mean length of test items are
computed in Spark.  Items are dealt into index shards of at most SHARD_ITEMS
items of one length class (the size of SHARDS_PER_PASS of them is bounded, so
they may be broadcast, and texts are read once for that many); in a shard, blocks of
BLOCK_ITEMS items keep each term's largest impact.  An impact is the term's
BM25 weight in the item over the item's weight for all its own terms, so a
score is the share of an item's BM25 mass that a passage covers, from 0 to 1.

*Search.*  Every text is cut into overlapping passages that hold any item of the
length class whole (their width depends on the class alone, not on which other
items there are) and each passage is a query.  Passages whose terms' largest impacts add up to
less than the threshold are skipped; for the others the sums of the block
maxima tell which blocks may hold an item above the threshold, and only those
are scored.  The skipped ones cannot reach the threshold, so all items above it
are found.

*Verification.*  An item has a question and an answer (without an ``answer``
column: its first two thirds of words and the rest).  A hit is verified if
enough of the word trigrams of both occur in the passage (in a short part, all
but those of one word).  Of an item of fewer than MIN_TERMS words all must stand
there in a row.

Terms are lower-case words without the punctuation at their ends.

Edge cases: null or wordless texts and items match nothing; repeated documents are searched each, repeated items are all reported; null ids
are reported as null; empty tables give an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import blocks, ragged, words_of

K1, B = 1.2, 0.75
THRESHOLD = 0.55
OVERLAP = 0.7
GRAM = 3
MIN_TERMS = 8
SHARD_ITEMS = 2048
SHARDS_PER_PASS = 8
BLOCK_ITEMS = 16
BLOCK_BYTES = 2 << 20
EDGES = ".,;:!?\"'()[]{}<>«»„“”‘’…-–—"


def normal(word: str) -> str:
    """The term of a word: lower case, without punctuation at its ends (none if nothing is left)."""
    return word.lower().strip(EDGES)


@dataclass
class IndexShard:
    """An inverted index of some items with block maxima."""

    terms: dict[str, int]
    first: np.ndarray  # postings of term t: first[t]:first[t + 1]
    items: np.ndarray
    impacts: np.ndarray
    top: np.ndarray  # largest impact of each term
    block_top: np.ndarray  # terms x blocks
    ids: list[int | None]
    parts: list[tuple[list[int], list[int]]]  # term ids of question and answer
    width: int  # words of any item at most


def length_class(n: int) -> int:
    """The width of an item of ``n`` terms: 32, 64, 128 and so on."""
    return max(32, 1 << max(0, n - 1).bit_length())


def build_shard(rows: list[tuple[int | None, list[str], list[str]]], df: dict[str, int], n_items: int, mean_len: float) -> IndexShard:
    """Index items given as (id, question terms, answer terms)."""
    terms: dict[str, int] = {}
    parts, postings = [], []
    for i, (_, q, a) in enumerate(rows):
        coded = [terms.setdefault(t, len(terms)) for t in q + a]
        parts.append((coded[: len(q)], coded[len(q) :]))
        tf: dict[str, int] = {}
        for t in q + a:
            tf[t] = tf.get(t, 0) + 1
        norm = K1 * (1 - B + B * len(coded) / mean_len)
        weight = {t: np.log1p((n_items - df[t] + 0.5) / (df[t] + 0.5)) * n * (K1 + 1) / (n + norm) for t, n in tf.items()}
        whole = sum(weight.values())
        postings += [(terms[t], i, w / whole) for t, w in weight.items()]
    postings.sort()
    t = np.array([p[0] for p in postings], np.int64)
    items = np.array([p[1] for p in postings], np.int64)
    impacts = np.array([p[2] for p in postings], np.float32)
    first = np.searchsorted(t, np.arange(len(terms) + 1))
    block_top = np.zeros((len(terms), -(-max(len(rows), 1) // BLOCK_ITEMS)), np.float32)
    np.maximum.at(block_top, (t, items // BLOCK_ITEMS), impacts)
    width = max((length_class(len(q) + len(a)) for _, q, a in rows), default=32)
    return IndexShard(terms, first, items, impacts, block_top.max(axis=1, initial=0), block_top, [r[0] for r in rows], parts, width)


def passages(offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, first word and number of words of passages of 2 * width words, width apart."""
    sizes = np.diff(offsets)
    counts = np.where(sizes > 0, np.maximum(1, -(-sizes // width) - 1), 0)
    text = np.repeat(np.arange(len(sizes)), counts)
    number = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = number * width
    return text, offsets[text] + start, np.minimum(2 * width, sizes[text] - start)


def search(terms: np.ndarray, offsets: np.ndarray, shard: IndexShard, threshold: float) -> Iterator[tuple[int, int, int, int, float]]:
    """(text, first word, words, item, score) of all passages and items above the threshold.

    ``terms`` has the index's term of every word, -1 for none.
    """
    text, start, size = passages(offsets, shard.width)
    for lo in range(0, len(text), 20_000):
        part = slice(lo, lo + 20_000)
        owner = np.repeat(np.arange(len(text[part])), size[part])
        found = terms[ragged(start[part], size[part])]
        hit = found >= 0
        pairs = np.unique(owner[hit] * np.int64(len(shard.terms) + 1) + found[hit])
        owner, found = pairs // (len(shard.terms) + 1), pairs % (len(shard.terms) + 1)
        # Skip passages that no item can match.
        bound = np.bincount(owner, weights=shard.top[found], minlength=len(text[part]))
        go = bound[owner] >= threshold
        owner, found = owner[go], found[go]
        if not len(owner):
            continue
        begins = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        ends = np.append(begins[1:], len(owner))
        step = max(1, (1 << 22) // shard.block_top.shape[1])
        for a in range(0, len(begins), max(1, step // 64)):
            b = min(len(begins), a + max(1, step // 64))
            sums = np.add.reduceat(shard.block_top[found[begins[a] : ends[b - 1]]], begins[a:b] - begins[a], axis=0)
            for row in np.flatnonzero((sums >= threshold).any(axis=1)):
                mine = found[begins[a + row] : ends[a + row]]
                n = shard.first[mine + 1] - shard.first[mine]
                at = ragged(shard.first[mine], n)
                wanted = (sums[row] >= threshold)[shard.items[at] // BLOCK_ITEMS]
                score = np.bincount(shard.items[at[wanted]], weights=shard.impacts[at[wanted]], minlength=len(shard.ids))
                p = lo + owner[begins[a + row]]
                for item in np.flatnonzero(score >= threshold):
                    yield int(text[p]), int(start[p]), int(size[p]), int(item), float(score[item])


def overlap(part: list[int], grams: set[tuple[int, ...]]) -> tuple[int, int]:
    """How many of the word n-grams of ``part`` are in ``grams``, and how many there are."""
    n = min(GRAM, len(part))
    mine = [tuple(part[i : i + n]) for i in range(len(part) - n + 1)] if n else []
    return sum(g in grams for g in mine), len(mine)


def enough(found: int, of: int, least: float) -> bool:
    """The share ``least``, or all n-grams but those of one word where these are more than the rest; half of them at any rate."""
    return found >= max(min(least * of, of - GRAM), 0.5 * of)


def in_a_row(words: list[int], part: list[int]) -> bool:
    n = len(part)
    return any(words[i : i + n] == part for i in range(len(words) - n + 1))


def _verify(words: list[int], shard: IndexShard, item: int, least: float) -> tuple[float, float] | None:
    """Overlap of question and answer, None if the item is not there."""
    q, a = shard.parts[item]
    if len(q) + len(a) < MIN_TERMS:
        return (1.0, 1.0) if in_a_row(words, q + a) else None
    sizes = {min(GRAM, len(p)) for p in (q, a) if p}
    grams = {tuple(words[i : i + n]) for n in sizes for i in range(len(words) - n + 1)}
    counts = [overlap(p, grams) for p in (q, a)]
    if not all(enough(f, n, least) for f, n in counts):
        return None
    return tuple(f / n if n else 1.0 for f, n in counts)


def _split(row) -> tuple[list[str], list[str]]:
    q = [t for w in (row["text"] or "").split() if (t := normal(w))]
    if "answer" in row:
        return q, [t for w in (row["answer"] or "").split() if (t := normal(w))]
    cut = -(-2 * len(q) // 3)
    return q[:cut], q[cut:]


def index_shards(benchmark: DataFrame, id_column: str = "item_id", text_column: str = "text", answer_column: str | None = None) -> Iterator[IndexShard]:
    """The index of ``benchmark``, a bounded shard at a time."""
    from ._common import materialize

    cols = [F.col(id_column).cast("bigint").alias("id"), F.col(text_column).alias("text"), *([F.col(answer_column).alias("answer")] if answer_column else [])]
    items = benchmark.select(*cols)
    answered = answer_column is not None

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(r["id"], *_split(r)) for r in b.to_pylist()]
            rows = [r for r in rows if r[1] or r[2]]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.string())), pa.array([r[2] for r in rows], pa.list_(pa.string()))], names=["id", "q", "a"])

    spark = benchmark.sparkSession
    found = materialize(spark, items.mapInArrow(terms, "id bigint, q array<string>, a array<string>"), "items")
    stats = found.agg(F.count("*").alias("n"), F.avg(F.size("q") + F.size("a")).alias("mean")).first()
    df = found.select(F.explode(F.array_distinct(F.concat("q", "a"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    size = F.size("q") + F.size("a")
    width = F.greatest(F.lit(32), F.pow(F.lit(2), F.ceil(F.log2(size))).cast("int"))
    classes = {r.width: r.n for r in found.groupBy(width.alias("width")).agg(F.count("*").alias("n")).collect()}  # one row for each power of two
    parts = {w: max(1, -(-n // (SHARD_ITEMS // 2))) for w, n in classes.items()}
    first = dict(zip(sorted(parts), np.cumsum([0, *(parts[w] for w in sorted(parts))]).tolist(), strict=False))
    shard = F.coalesce(*(F.when(width == w, F.lit(first[w]) + F.pmod(F.xxhash64("id", "q", "a"), F.lit(parts[w]))) for w in parts)) if parts else F.lit(0)
    dealt = materialize(spark, found.withColumn("shard", shard), "items")
    used = materialize(spark, dealt.select("shard", F.explode(F.array_distinct(F.concat("q", "a"))).alias("term")).distinct().join(df, "term"), "terms")
    for k in range(sum(parts.values())):
        rows = [(r.id, r.q, r.a) for r in dealt.where(F.col("shard") == k).select("id", "q", "a").toLocalIterator()]  # about SHARD_ITEMS / 2
        freq = {r.term: r.df for r in used.where(F.col("shard") == k).select("term", "df").toLocalIterator()}
        yield build_shard(rows, freq, stats.n, stats.mean or 1.0)


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, least: float = OVERLAP, **columns: str) -> DataFrame:
    """(doc_id, text_key, item_id, score, question_overlap, answer_overlap, first_word): the verified hits; text_key is a hash of the text.

    For each document and item the best passage.
    """
    spark = docs.sparkSession
    shards = index_shards(benchmark, **columns)
    schema = "doc_id bigint, text_key bigint, item_id bigint, score double, question_overlap double, answer_overlap double, first_word bigint"
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    out = None
    while some := list(islice(shards, SHARDS_PER_PASS)):
        held = spark.sparkContext.broadcast(some)  # of bounded size

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for block in blocks(batches, "text", BLOCK_BYTES):
                codes, offsets, words = words_of(block.column("text"))
                normals = [normal(w) for w in words.to_pylist()]
                real = np.fromiter(map(bool, normals), bool, len(normals))[codes]  # words of punctuation only are no terms
                offsets = np.concatenate(([0], np.cumsum(real)))[offsets]
                codes = codes[real]
                for shard in held.value:
                    known = np.fromiter((shard.terms.get(w, -1) for w in normals), np.int64, len(normals))
                    terms = known[codes]
                    best: dict[tuple[int, int], tuple] = {}
                    for text, start, size, item, score in search(terms, offsets, shard, threshold):
                        found = _verify(terms[start : start + size].tolist(), shard, item, least)
                        if found and (score, -start) > best.get((text, item), (0.0, 0))[:2]:
                            best[text, item] = (score, -start, *found, start - int(offsets[text]))
                    rows = list(best.values())
                    at = pa.array([k[0] for k in best], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [block.column("doc_id").take(at), block.column("text_key").take(at), pa.array([shard.ids[k[1]] for k in best], pa.int64()), *(pa.array([r[i] for r in rows], pa.float64()) for i in (0, 2, 3)), pa.array([r[4] for r in rows], pa.int64())],
                        names=["doc_id", "text_key", "item_id", "score", "question_overlap", "answer_overlap", "first_word"],
                    )

        found = texts.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out
