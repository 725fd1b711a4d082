"""Token-id output: static range asymmetric numeral system (rANS) shards.

Writing takes two passes.  The first tokenises every text once, keeps the
compressed ids and counts ids per task; the counts (one per id of the
vocabulary, so bounded by it) become one shared frequency table.  The second
sorts documents by range partitions of ``doc_id`` and cuts each partition into
independent blocks.  A block is a self-contained image:

    fixed header   magic, version, lanes, tokens, documents, stream words
    directory      doc ids, null flags, ids per document
    checkpoints    stream position and all lane states every CHECK_STEPS steps
    stream         32-bit words of all lanes, interleaved
    checksum       crc32 of everything before it

Images are stored as binary rows of Parquet files, so that Spark's commit
protocol covers them on every file system and a lost executor leaves no half
file.  All lanes of a block are decoded at once, any block without the others,
and decoding may begin at any checkpoint.

Edge cases: a null text is encoded as an empty one (only the end id); a null
``doc_id`` sorts first; repeated ``doc_id`` values are kept, each as a document,
ordered by n_tokens and then by the ids' checksum; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import blocks, materialize, pack, ragged, scratch, unpack, words_of

SCALE_BITS = 20
CHECK_STEPS = 64
MAX_LANES = 1024
BLOCK_TOKENS = 1 << 18
MAGIC = b"RANB"
VERSION = 1
HEAD = struct.Struct("<4sHHIIIIQ")
LOW = np.uint64(1 << 32)
S32 = np.uint64(32)
BITS = np.uint64(SCALE_BITS)


@dataclass(frozen=True)
class FrequencyTable:
    """Scaled frequencies (they sum to 2**SCALE_BITS) and their prefix sums."""

    freq: np.ndarray
    cum: np.ndarray
    slots: np.ndarray

    @staticmethod
    def from_counts(counts: np.ndarray) -> FrequencyTable:
        """Scale counts so that every id that occurs keeps a share of at least one slot."""
        total = 1 << SCALE_BITS
        freq = np.zeros(len(counts), dtype=np.int64)
        seen = np.flatnonzero(counts)
        if len(seen) > total:
            raise ValueError(f"more than {total} different ids")
        if len(seen):
            share = counts[seen].astype(np.float64) * ((total - len(seen)) / counts[seen].sum())
            freq[seen] = 1 + np.floor(share).astype(np.int64)
            freq[seen[np.argmax(counts[seen])]] += total - int(freq.sum())
        return FrequencyTable.from_frequencies(freq)

    @staticmethod
    def from_frequencies(freq: np.ndarray) -> FrequencyTable:
        cum = np.concatenate(([0], np.cumsum(freq)[:-1])) if len(freq) else freq
        return FrequencyTable(freq.astype(np.uint64), cum.astype(np.uint64), np.repeat(np.arange(len(freq), dtype=np.uint32), freq))


def _lanes(n: int) -> int:
    return 1 << max(0, min(MAX_LANES.bit_length() - 1, (n // 256).bit_length()))


def encode_block(ids: np.ndarray, counts: np.ndarray, doc_ids: np.ndarray, nulls: np.ndarray, table: FrequencyTable) -> bytes:
    """The image of one block; ``counts`` has the number of ids of each document."""
    n, lanes = len(ids), _lanes(len(ids))
    steps = -(-n // lanes)
    padded = np.full(steps * lanes, int(np.argmax(table.freq)) if n else 0, dtype=np.int64)
    padded[:n] = ids
    f, c = table.freq[padded].reshape(steps, lanes), table.cum[padded].reshape(steps, lanes)
    x = np.full(lanes, LOW, dtype=np.uint64)
    chunks: list[np.ndarray] = []
    marks: list[np.ndarray] = []
    limit = f << np.uint64(64 - SCALE_BITS)
    whole = f == np.uint64(1 << SCALE_BITS)  # the limit of a certain id would overflow; it needs no renormalisation
    for s in range(steps - 1, -1, -1):
        full = (x >= limit[s]) & ~whole[s]
        chunks.append(x[full].astype(np.uint32))
        x[full] >>= S32
        q, r = np.divmod(x, f[s])
        x = (q << BITS) + r + c[s]
        if s % CHECK_STEPS == 0:
            marks.append(x.copy())
    sizes = np.array([len(k) for k in reversed(chunks)], dtype=np.int64)
    before = np.concatenate(([0], np.cumsum(sizes)))
    stream = np.concatenate(chunks[::-1]) if chunks else np.zeros(0, np.uint32)
    marks.reverse()
    at = before[np.arange(len(marks)) * CHECK_STEPS].astype(np.uint32) if marks else np.zeros(0, np.uint32)
    body = b"".join(
        [
            HEAD.pack(MAGIC, VERSION, lanes, n, len(counts), len(marks), len(stream), steps),
            doc_ids.astype("<i8").tobytes(),
            nulls.astype(np.uint8).tobytes(),
            counts.astype("<u4").tobytes(),
            at.astype("<u4").tobytes(),
            b"".join(m.astype("<u8").tobytes() for m in marks),
            stream.astype("<u4").tobytes(),
        ]
    )
    return body + struct.pack("<I", zlib.crc32(body))


@dataclass(frozen=True)
class Block:
    """The parts of a block image."""

    n: int
    lanes: int
    steps: int
    doc_ids: np.ndarray
    nulls: np.ndarray
    counts: np.ndarray
    at: np.ndarray
    marks: np.ndarray
    stream: np.ndarray


def open_block(image: bytes) -> Block:
    """Check the checksum of an image and find its parts."""
    if zlib.crc32(memoryview(image)[:-4]) != struct.unpack("<I", image[-4:])[0]:
        raise ValueError("damaged block: its checksum differs")
    magic, version, lanes, n, docs, n_marks, words, steps = HEAD.unpack_from(image)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a block of this format")
    pos = HEAD.size

    def take(dtype: str, count: int) -> np.ndarray:
        nonlocal pos
        out = np.frombuffer(image, dtype=dtype, count=count, offset=pos)
        pos += out.nbytes
        return out

    return Block(n, lanes, steps, take("<i8", docs), take("u1", docs), take("<u4", docs), take("<u4", n_marks), take("<u8", n_marks * lanes).reshape(n_marks, lanes), take("<u4", words))


def decode_steps(block: Block, table: FrequencyTable, mark: int = 0, marks: int | None = None) -> np.ndarray:
    """The ids from checkpoint ``mark`` on, for so many checkpoint intervals (all by default)."""
    first = mark * CHECK_STEPS
    last = block.steps if marks is None else min(block.steps, first + marks * CHECK_STEPS)
    if first >= last:
        return np.zeros(0, dtype=np.int64)
    x, p = block.marks[mark].astype(np.uint64), int(block.at[mark])
    out = np.empty((last - first, block.lanes), dtype=np.uint32)
    low, freq, cum, slots, stream = np.uint64((1 << SCALE_BITS) - 1), table.freq, table.cum, table.slots, block.stream
    for s in range(last - first):
        slot = x & low
        sym = slots[slot]
        out[s] = sym
        x = freq[sym] * (x >> BITS) + slot - cum[sym]
        short = x < LOW
        k = int(np.count_nonzero(short))
        if k:
            x[short] = (x[short] << S32) | stream[p : p + k]
            p += k
    return out.reshape(-1)[: block.n - first * block.lanes].astype(np.int64)


def decode_block(image: bytes, table: FrequencyTable) -> tuple[Block, np.ndarray]:
    """A block and all its ids."""
    block = open_block(image)
    return block, decode_steps(block, table)


class WordEncoder:
    """Encoder of a tokenizers file whose pre-tokens never cross white space.

    Texts are cut at ASCII white space.  Words of PLAIN characters, which the
    file's normaliser only lower-cases, are cut by the file's own pattern in
    Arrow, and each distinct piece passes the library's model; any other word
    passes the library as it is, and so does every word that may hold a special
    token.  The words' ids, put together, are those of the whole text.  At most
    CACHE_PIECES pieces and those of one block are remembered, so memory is
    bounded.  Files of another make are left to the library, text by text.
    """

    CACHE_PIECES = 200_000
    #: Visible ASCII, and Latin letters that have one lower-case form and stay as they are in NFC.
    PLAIN = r"^[\x21-\x7E\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}]+$"
    #: Of these in lower case: the letters, and what is neither a letter nor a digit nor the apostrophe, which the pattern treats apart.
    LETTERS = "".join(map(chr, sorted({ord(chr(c).lower()) for c in [*range(0x61, 0x7B), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x130), *range(0x131, 0x250)]})))
    MARKS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum() and c != "'")
    NORMALIZERS = ["NFC", "Replace", "Lowercase"]

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        cutters = (made["pre_tokenizer"] or {}).get("pretokenizers", [])
        steps = [n["type"] for n in (made["normalizer"] or {}).get("normalizers", [])]
        self.by_word = steps == self.NORMALIZERS and [c["type"] for c in cutters] == ["Split", "ByteLevel"] and cutters[0]["invert"] and cutters[0]["behavior"] == "Removed" and not cutters[1]["use_regex"] and not cutters[1]["add_prefix_space"]
        self.pattern = f"({cutters[0]['pattern']['Regex']})" if self.by_word else ""
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        # The byte-level alphabet: visible Latin-1 bytes stand for themselves, the others for the characters from 256 on.
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in shown]
        self.alphabet = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        self._remember(pa.array([], pa.large_string()), np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def _remember(self, pieces: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.known, self.ids, self.sizes = pieces, ids, sizes

    def _model(self, piece: str) -> bytes:
        mapped = piece if piece.isascii() else "".join(map(self.alphabet.__getitem__, piece.encode()))
        return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct pieces, where those of each piece begin, and how many they are."""
        found = pc.index_in(pieces, value_set=self.known)
        new = pieces.filter(pc.is_null(found))
        flat, n = _joined([self._model(x) for x in new.to_pylist()])
        at = np.asarray(pc.fill_null(found, -1), dtype=np.int64)
        at[at < 0] = len(self.known) + np.arange(len(new))
        self._remember(pa.concat_arrays([self.known, new]), np.concatenate((self.ids, flat)), np.concatenate((self.sizes, n)))
        ids, starts, sizes = self.ids, np.cumsum(self.sizes) - self.sizes, self.sizes
        if len(self.known) > self.CACHE_PIECES:
            self._remember(pieces, ids[ragged(starts[at], sizes[at])], sizes[at])
        return ids, starts[at], sizes[at]

    def _library(self, words: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.whole.encode_batch_fast(words, add_special_tokens=False)]

    def _cut(self, words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The pieces of lower-case plain words, and where those of each word begin (and the last ends).

        A word of letters, or of letters and then marks, needs no pattern: such
        runs are what it cuts.  Only the others are matched.
        """
        core = pc.utf8_rtrim(words, characters=self.MARKS)
        simple = pc.utf8_is_alpha(core)
        only = np.asarray(simple.cast(pa.uint8())) > 0
        core, tail = core.filter(simple), pc.utf8_ltrim(words.filter(simple), characters=self.LETTERS)
        marked = pc.replace_substring_regex(words.filter(pc.invert(simple)), self.pattern, r"\1 ")
        lists = pc.split_pattern(pc.ascii_rtrim_whitespace(marked), " ")
        offsets = np.asarray(lists.offsets, dtype=np.int64)
        has = np.asarray(pc.binary_length(tail)) > 0
        sizes = np.empty(len(words), np.int64)
        sizes[only], sizes[~only] = 1 + has, np.diff(offsets)
        ends = np.concatenate(([0], np.cumsum(sizes)))
        parts = pa.concat_arrays([core, tail, lists.values])
        take = np.empty(ends[-1], np.int64)
        take[ends[:-1][only]] = np.arange(len(core))
        take[ends[:-1][only][has] + 1] = len(core) + np.flatnonzero(has)
        take[ragged(ends[:-1][~only], sizes[~only])] = 2 * len(core) + np.arange(len(lists.values))
        return parts.take(pa.array(take)), ends

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words, where those of each word begin, and how many they are."""
        plain = pc.match_substring_regex(words, self.PLAIN)
        for token in self.special:
            plain = pc.and_not(plain, pc.match_substring(words, token))
        easy = np.asarray(plain.cast(pa.uint8())) > 0
        pieces, ends = self._cut(pc.utf8_lower(words.filter(plain)))
        coded = pieces.dictionary_encode()
        flat, first, n = self._pieces(coded.dictionary)
        codes = np.asarray(coded.indices, dtype=np.int64)
        at = np.concatenate(([0], np.cumsum(n[codes])))[ends]
        ids = flat[ragged(first[codes], n[codes])]
        other, m = _joined(self._library(words.filter(pc.invert(plain)).to_pylist()))
        starts, sizes = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        starts[easy], sizes[easy] = at[:-1], np.diff(at)
        starts[~easy], sizes[~easy] = len(ids) + np.cumsum(m) - m, m
        return np.concatenate((ids, other)), starts, sizes

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the number of ids of each text."""
        if not self.by_word:
            return _joined(self._library(pc.fill_null(texts, "").to_pylist()))
        codes, offsets, words = words_of(texts)
        table, starts, sizes = self.encode_words(words)
        per_word = sizes[codes]
        ends = np.concatenate(([0], np.cumsum(per_word)))
        return table[ragged(starts[codes], per_word)], np.diff(ends[offsets])


def _joined(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found)) // 4


_ENCODERS: dict[str, WordEncoder] = {}


def encode_words(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and the number of ids of each text."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path].encode_texts(texts)


def tokenize(docs: DataFrame, path: str, end_id: int | None, vocab: int, encode: Callable = encode_words) -> DataFrame:
    """Packed ids per document (kind 0) and id counts per task (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = np.zeros(vocab, dtype=np.int64)
        for block in blocks(batches, "text", 4 << 20):
            ids, counts = encode(block.column("text"), path)
            if end_id is not None:
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, end_id).astype(np.uint32)
                counts = counts + 1
            tally += np.bincount(ids, minlength=vocab)
            starts = np.cumsum(counts) - counts
            data = [ids[a : a + n] for a, n in zip(starts, counts, strict=True)]
            yield _packed(block.column("doc_id"), counts, [pack(x) for x in data], [zlib.crc32(x.astype("<u4").tobytes()) for x in data], 0)
        yield _packed(pa.array([None], pa.int64()), np.array([vocab]), [pack(tally)], [0], 1)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids binary, crc bigint, kind int")


def _packed(doc_ids: pa.Array, counts: np.ndarray, ids: list[bytes], crcs: list[int], kind: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [doc_ids.cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.binary()), pa.array(crcs, pa.int64()), pa.array([kind] * len(ids), pa.int32())],
        names=["doc_id", "n_tokens", "ids", "crc", "kind"],
    )


def write_token_shards(docs: DataFrame, out: str, tokenizer_path: str, end_id: int | None, vocab: int, encode: Callable = encode_words) -> None:
    """Encode all texts into shards at ``out``: ``blocks`` (images) and ``table`` (frequencies)."""
    spark = docs.sparkSession
    packed = materialize(spark, tokenize(docs, tokenizer_path, end_id, vocab, encode), "tokens", "kind")
    tally = np.zeros(vocab, dtype=np.int64)
    # One fixed-size row per scan task, no larger than the vocabulary: summed in Spark first.
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocab, dtype=np.int64)
        for b in batches:
            for x in b.column("ids").to_pylist():
                total += unpack(x, vocab, np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["id", "n"])

    counts = packed.where("kind = 1").select("ids").mapInArrow(summed, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    for row in counts.toLocalIterator():  # at most ``vocab`` rows
        tally[row.id] = row.n
    table = FrequencyTable.from_counts(tally)
    freq = table.freq
    spark.createDataFrame([(VERSION, SCALE_BITS, bytearray(pack(freq.astype(np.uint32))), len(freq))], "version int, scale_bits int, freq binary, n int").coalesce(1).write.parquet(f"{out}/table")

    docs_packed = packed.where("kind = 0").select("doc_id", "n_tokens", "crc", "ids")
    size = docs_packed.agg(F.sum("n_tokens")).first()[0] or 0
    parts = max(1, -(-size // (8 * BLOCK_TOKENS)))
    ordered = docs_packed.repartitionByRange(int(parts), F.asc_nulls_first("doc_id"), "n_tokens", "crc").sortWithinPartitions(F.asc_nulls_first("doc_id"), "n_tokens", "crc")

    def images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, number = TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, int, int]] = []
        size = 0

        def image() -> pa.RecordBatch:
            ids = np.concatenate([x for x, _, _ in held])
            data = encode_block(ids, np.array([len(x) for x, _, _ in held]), np.array([d for _, d, _ in held]), np.array([z for _, _, z in held]), table)
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([data], pa.binary())], names=["shard", "block", "n_tokens", "image"])

        for b in batches:
            for d, n, x in zip(*(b.column(k).to_pylist() for k in ("doc_id", "n_tokens", "ids")), strict=True):
                held.append((unpack(x, n, np.uint32), d or 0, d is None))
                size += n
                if size >= BLOCK_TOKENS:
                    yield image()
                    held, size, number = [], 0, number + 1
        if held:
            yield image()

    ordered.select("doc_id", "n_tokens", "ids").mapInArrow(images, "shard int, block int, n_tokens bigint, image binary").write.option("compression", "none").parquet(f"{out}/blocks")


def read_token_shards(spark: SparkSession, path: str, per_document: Callable[[np.ndarray], int] | None = None) -> DataFrame:
    """Decode shards to (doc_id, start, n_tokens, ids_crc32, shard, block[, ids]).

    ``start`` counts the ids of all documents before; it needs the totals of
    blocks, one small row for each.
    """
    from pyspark.sql import Window

    row = spark.read.parquet(f"{path}/table").first()
    table = FrequencyTable.from_frequencies(unpack(bytes(row.freq), row.n, np.uint32).astype(np.int64))
    images = spark.read.parquet(f"{path}/blocks")
    sizes = images.select("shard", "block", "n_tokens")
    in_shard = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    shards = sizes.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("shard_start"))
    starts = sizes.withColumn("in_shard", F.coalesce(F.sum("n_tokens").over(in_shard), F.lit(0))).join(shards, "shard").select("shard", "block", (F.col("in_shard") + F.col("shard_start")).alias("block_start"))
    keep = per_document is None

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, k, image in zip(*(b.column(c).to_pylist() for c in ("shard", "block", "image")), strict=True):
                block, ids = decode_block(image, table)
                counts = block.counts.astype(np.int64)
                begin = np.cumsum(counts) - counts
                raw = ids.astype("<u4")
                crcs = [zlib.crc32(raw[a : a + n].tobytes()) for a, n in zip(begin, counts, strict=True)]
                arrays = [pa.array(block.doc_ids, pa.int64(), mask=block.nulls.astype(bool)), pa.array(begin), pa.array(counts), pa.array(crcs, pa.int64()), pa.array([s] * len(counts), pa.int32()), pa.array([k] * len(counts), pa.int32())]
                names = ["doc_id", "in_block", "n_tokens", "ids_crc32", "shard", "block"]
                if keep:
                    arrays.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(ids, pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    found = images.select("shard", "block", "image").mapInArrow(decode, "doc_id bigint, in_block bigint, n_tokens bigint, ids_crc32 bigint, shard int, block int" + ", ids array<bigint>" * keep)
    return found.join(starts, ["shard", "block"]).select("doc_id", (F.col("block_start") + F.col("in_block")).alias("start"), "n_tokens", "ids_crc32", "shard", "block", *["ids"] * keep)


def token_digests(docs: DataFrame, tokenizer_path: str, end_id: int, vocab: int) -> DataFrame:
    """Write the shards of ``docs`` and return the digests read back from them."""
    spark = docs.sparkSession
    path = scratch(spark, "shards")
    write_token_shards(docs, path, tokenizer_path, end_id, vocab)
    return read_token_shards(spark, path, per_document=len)
