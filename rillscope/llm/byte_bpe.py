"""Byte-level BPE by a global shuffle of distinct words, and decoding.

1. *Explode.*  Texts are cut into pre-tokens by the tokenizer's pattern.  A
   block of documents numbers its distinct pre-tokens; a document becomes the
   positions' numbers (packed).
2. *Encode each distinct word once.*  The blocks send their distinct words to
   shards by word hash; a shard encodes each word that any block has once.
3. *Join back and reassemble by position.*  The shard's answers return to the
   blocks, where positions' numbers become ids again.
4. *Decode.*  Ids are looked up in the table of token bytes (one entry per
   rank, so bounded by the vocabulary file).

A hot word is sent once per block, so no shard or block grows with it.  Texts
are cut twice, from the same scan, once for the words and once for the
positions: that takes less disk than to keep the positions.  The cut into input
tasks is pinned, and a block's words carry a checksum through the answers, so a
second reading that differs from the first ends the job instead of mixing words
up.  ``docs`` that are not a plain scan are written to shared storage first.

Edge cases: a null text is encoded as an empty one (no ids); null, repeated
and tied ``doc_id`` values are kept as they are, a row for each input row; a
very long text is a block of its own; an empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import blocks, materialize, pack, pin_splits, ragged, shards_for, text_bytes, unpack

BLOCK_BYTES = 6 << 20
SHARD_TEXT_BYTES = 24 << 20
_ENCODINGS: dict[tuple[str, str], object] = {}
_PATTERNS: dict[str, object] = {}


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def encoding(path: str, pattern: str):
    """The encoder of a rank file; one for each Python process."""
    if (path, pattern) not in _ENCODINGS:
        import tiktoken

        _ENCODINGS[path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})
    return _ENCODINGS[path, pattern]


def pre_tokens(pattern: str) -> Callable[[str], list[str]]:
    """The function that cuts a text into the matches of ``pattern``."""
    if pattern not in _PATTERNS:
        import regex

        _PATTERNS[pattern] = regex.compile(pattern).findall
    return _PATTERNS[pattern]


def _words(parts: np.ndarray, shard: int, words: list[bytes]) -> tuple[bytes, bytes, int, int]:
    """The block's words of one shard: lengths, then bytes."""
    mine = [words[i] for i in np.flatnonzero(parts == shard)]
    return pack(np.fromiter(map(len, mine), np.uint32, len(mine))), pa.compress(b"".join(mine), codec="zstd", asbytes=True), sum(map(len, mine)), len(mine)


def explode(docs: DataFrame, pattern: str, shards: int, words_only: bool) -> DataFrame:
    """The blocks' distinct words by shard (kind 1), or their documents (kind 0: packed positions) and the words' shards (kind 3)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        cut, task = pre_tokens(pattern), TaskContext.get().partitionId()
        for number, block in enumerate(blocks(batches, "text", BLOCK_BYTES)):
            name = (task << 32) | number
            seen: dict[str, int] = {}
            sizes, data = [], []
            for text in block.column("text"):
                found = cut(text.as_py() or "")
                if words_only:
                    seen.update(dict.fromkeys(found))  # in the order of the first occurrence
                else:
                    sizes.append(len(found))
                    data.append(pack(np.fromiter((seen.setdefault(w, len(seen)) for w in found), np.uint32, len(found))))
            words = [w.encode() for w in seen]
            parts = np.fromiter((zlib.crc32(w) for w in words), np.uint32, len(words)) % np.uint32(shards)
            if words_only:
                sent = [(p, *_words(parts, p, words)) for p in np.unique(parts)]
                yield _rows(name, 1, pa.array([zlib.crc32(b"\n".join(words))] * len(sent), pa.int64()), [s[4] for s in sent], [s[1] for s in sent], [s[2] for s in sent], [s[3] for s in sent], [int(s[0]) for s in sent])
            else:
                yield _rows(name, 3, pa.array([zlib.crc32(b"\n".join(words))]), [len(words)], [pack(parts)], [None], [0], [-1])
                yield _rows(name, 0, block.column("doc_id"), sizes, data, [None] * len(sizes), [0] * len(sizes), [-1] * len(sizes))

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


#: ``doc_id`` of rows that are no document (kinds 1, 2 and 3) is the checksum of the block's words.
SCHEMA = "block bigint, kind int, doc_id bigint, n bigint, data binary, more binary, n_more bigint, shard int"


def _rows(block: int, kind: int, doc_ids: pa.Array, n: list[int], data: list[bytes], more: list, n_more: list[int], shard: list[int]) -> pa.RecordBatch:
    k = len(n)
    return pa.RecordBatch.from_arrays(
        [pa.array([block] * k, pa.int64()), pa.array([kind] * k, pa.int32()), doc_ids.cast(pa.int64()), pa.array(n, pa.int64()), pa.array(data, pa.binary()), pa.array(more, pa.binary()), pa.array(n_more, pa.int64()), pa.array(shard, pa.int32())],
        names=["block", "kind", "doc_id", "n", "data", "more", "n_more", "shard"],
    )


def _unwords(data: bytes, more: bytes, n: int, size: int) -> list[bytes]:
    raw = pa.decompress(more, decompressed_size=size, codec="zstd", asbytes=True) if size else b""
    ends = np.cumsum(unpack(data, n, np.uint32), dtype=np.int64).tolist()
    return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def encode_shard(path: str, pattern: str) -> Callable[[pa.Table], pa.Table]:
    """Encode each distinct word of a shard once; answer every block (kind 2: sizes and ids)."""

    def run(table: pa.Table) -> pa.Table:
        enc = encoding(path, pattern)
        known: dict[bytes, list[int]] = {}
        out = []
        for row in table.to_batches():
            for block, check, n, data, more, size, shard in zip(*(row.column(c).to_pylist() for c in ("block", "doc_id", "n", "data", "more", "n_more", "shard")), strict=True):
                answer = []
                for w in _unwords(data, more, n, size):
                    ids = known.get(w)
                    if ids is None:
                        ids = known[w] = enc._encode_single_piece(w)
                    answer.append(ids)
                sizes = np.fromiter(map(len, answer), np.uint32, n)
                flat = np.fromiter((i for x in answer for i in x), np.uint32, int(sizes.sum()))
                out.append(_rows(block, 2, pa.array([check], pa.int64()), [n], [pack(sizes)], [pack(flat)], [len(flat)], [shard]))
        return pa.Table.from_batches(out, schema=out[0].schema)

    return run


def _assemble(table: pa.Table) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of a block's documents, from their positions and the shards' answers."""
    rows = {c: table.column(c).to_pylist() for c in ("kind", "doc_id", "n", "data", "more", "n_more", "shard")}
    kinds = np.array(rows["kind"])
    which = int(np.flatnonzero(kinds == 3)[0])
    words = rows["n"][which]
    shards = unpack(rows["data"][which], words, np.uint32)
    sizes, starts, flats = np.zeros(words, np.int64), np.zeros(words, np.int64), {}
    base = 0
    for i in np.flatnonzero(kinds == 2):
        mine = shards == rows["shard"][i]
        if np.count_nonzero(mine) != rows["n"][i] or rows["doc_id"][i] != rows["doc_id"][which]:
            raise RuntimeError("the input was read in another order the second time")
        k = unpack(rows["data"][i], rows["n"][i], np.uint32).astype(np.int64)
        sizes[mine], starts[mine] = k, base + np.cumsum(k) - k
        flats[i] = unpack(rows["more"][i], rows["n_more"][i], np.uint32)
        base += rows["n_more"][i]
    flat = np.concatenate(list(flats.values())) if flats else np.zeros(0, np.uint32)
    for i in np.flatnonzero(kinds == 0):
        pos = unpack(rows["data"][i], rows["n"][i], np.uint32)
        yield rows["doc_id"][i], flat[ragged(starts[pos], sizes[pos])]


def encode_documents(docs: DataFrame, path: str, pattern: str, finish: Callable[[np.ndarray], dict], schema: str) -> DataFrame:
    """Encode every text and apply ``finish`` to its ids; ``schema`` names what it returns.

    The result has ``doc_id``, ``n_tokens`` and the columns of ``schema``.
    """
    spark = docs.sparkSession
    pin_splits(spark)
    shards = shards_for(text_bytes(docs), SHARD_TEXT_BYTES)
    if "Exchange" in docs._jdf.queryExecution().executedPlan().toString():
        docs = materialize(spark, docs.select("doc_id", "text"), "texts")
    asked = explode(docs, pattern, shards, True)
    words = materialize(spark, asked.groupBy("shard").applyInArrow(encode_shard(path, pattern), SCHEMA), "words")
    names = [c.split()[0] for c in schema.split(",")]

    def reassemble(table: pa.Table) -> pa.Table:
        ids, sizes, out = [], [], {k: [] for k in names}
        for doc, found in _assemble(table):
            ids.append(doc)
            sizes.append(len(found))
            made = finish(found)
            for k in names:
                out[k].append(made[k])
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_tokens": pa.array(sizes, pa.int64())} | {k: pa.array(v) for k, v in out.items()})

    answers = explode(docs, pattern, shards, False).unionByName(words)
    return answers.groupBy("block").applyInArrow(reassemble, f"doc_id bigint, n_tokens bigint, {schema}")


def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The token-byte table: all tokens' bytes in order of rank, and where each begins (and the last ends)."""
    ranks = load_ranks(path)
    tokens = [b""] * (max(ranks.values()) + 1)
    for t, r in ranks.items():
        tokens[r] = t
    return np.frombuffer(b"".join(tokens), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in tokens])))


_TABLES: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def decode_ids(ids: np.ndarray, path: str) -> bytes:
    """The bytes of ids, joined with the token-byte table."""
    if path not in _TABLES:
        _TABLES[path] = token_bytes(path)
    data, at = _TABLES[path]
    starts = at[ids]
    return data[ragged(starts, at[ids.astype(np.int64) + 1] - starts)].tobytes()


def bpe_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded bytes."""

    def finish(ids: np.ndarray) -> dict:
        joined = " ".join(map(str, ids.tolist())).encode()
        return {"ids_sha256": hashlib.sha256(joined).hexdigest(), "decoded_sha256": hashlib.sha256(decode_ids(ids, path)).hexdigest()}

    return encode_documents(docs, path, pattern, finish, "ids_sha256 string, decoded_sha256 string")


def bpe_round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, the ids and the decoded text."""

    def finish(ids: np.ndarray) -> dict:
        return {"ids": ids.tolist(), "decoded": decode_ids(ids, path).decode()}

    return encode_documents(docs, path, pattern, finish, "ids array<bigint>, decoded string")
