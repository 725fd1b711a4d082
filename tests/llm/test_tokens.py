"""Token shards, byte-level BPE and length histograms against the libraries."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from rillscope.llm import byte_bpe, token_binary, token_counts

WORD = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_block_round_trip_and_checkpoints():
    rng = np.random.default_rng(0)
    for n, vocab in ((0, 5), (1, 1), (7, 3), (1000, 40), (200_000, 5000)):
        ids = np.minimum((rng.pareto(1.0, n) * 3).astype(np.int64), vocab - 1)
        table = token_binary.FrequencyTable.from_counts(np.bincount(ids, minlength=vocab))
        counts = np.array([n // 2, 0, n - n // 2])
        image = token_binary.encode_block(ids, counts, np.array([1, 0, 3]), np.array([0, 1, 0]), table)
        block, got = token_binary.decode_block(image, table)
        assert (got == ids).all() and block.counts.tolist() == counts.tolist() and block.nulls.tolist() == [0, 1, 0]
        for mark in range(len(block.marks)):
            part = token_binary.decode_steps(block, table, mark, 1)
            at = mark * token_binary.CHECK_STEPS * block.lanes
            assert (part == ids[at : at + len(part)]).all() and len(part)


def test_damage_is_seen():
    ids = np.arange(50)
    table = token_binary.FrequencyTable.from_counts(np.ones(50, np.int64))
    image = bytearray(token_binary.encode_block(ids, np.array([50]), np.array([0]), np.array([0]), table))
    image[40] ^= 1
    with pytest.raises(ValueError):
        token_binary.open_block(bytes(image))


def test_shards(spark, odd_docs, no_docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORD)
    out = token_binary.token_digests(odd_docs, WORD, 1, 49_408).collect()
    want = []
    for r in odd_docs.collect():
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 1]
        want.append((r.doc_id is not None, r.doc_id or 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    want.sort()
    start, expected = 0, []
    for has, i, n, crc in want:
        expected.append((i if has else None, start, n, crc))
        start += n
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in out), key=lambda x: x[1])
    assert got == expected
    assert token_binary.token_digests(no_docs, WORD, 1, 49_408).count() == 0


def test_word_encoder_equals_the_library():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORD)
    plain = [chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    texts = [*plain, *(f"a{c}b {c}{c}Q" for c in plain), *(f"é{c}1'S" for c in plain)]
    texts += ["<|endoftext|>", "x<|startoftext|>y", "<|ENDOFTEXT|>", "<|endoftext", "a\x00b \x7f x a\x1cb", "e\u0301 \u0301x", "ΣΑΣ İstanbul ǅ Ⱥ", "don't I'LL 'S 's's 're''", "日本語 😀😀", "", " ", "\u00a0a\u00a0", "\ud7ff", "x" * 5000]
    rng = np.random.default_rng(3)
    texts += ["".join(map(chr, rng.choice([*range(0x20, 0x7F), *range(0x20, 0x7F), *range(0x80, 0x250), 0x301, 0x2028], 60))) for _ in range(2000)]
    ids, counts = token_binary.encode_words(pa.array(texts), WORD)
    want = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    ends = np.concatenate(([0], np.cumsum(counts)))
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == want


def test_byte_bpe(odd_docs, no_docs):
    enc = byte_bpe.encoding(RANKS, public_tokenizers.PATTERN)
    want = []
    for r in odd_docs.collect():
        ids = enc.encode_ordinary(r.text or "")
        want.append((str(r.doc_id), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    got = [(str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.bpe_digests(odd_docs, RANKS, public_tokenizers.PATTERN).collect()]
    assert sorted(got) == sorted(want)
    assert byte_bpe.bpe_digests(no_docs, RANKS, public_tokenizers.PATTERN).count() == 0
    trip = byte_bpe.bpe_round_trip(odd_docs, RANKS, public_tokenizers.PATTERN).where("doc_id = 9").first()
    assert trip.decoded.startswith("naïve ΣΑΣ") and len(trip.ids) == trip.n_tokens


def test_length_histogram(odd_docs, no_docs):
    enc = byte_bpe.encoding(RANKS, public_tokenizers.PATTERN)
    lengths = sorted(len(enc.encode_ordinary(r.text or "")) for r in odd_docs.collect())
    hist = token_counts.length_histogram(token_counts.encoded_lengths(odd_docs, RANKS, public_tokenizers.PATTERN)).cache()
    for r in hist.collect():
        n = r.n_tokens
        assert r.docs == Counter(lengths)[n]
        assert r.docs_at_least == sum(x >= n for x in lengths) and r.docs_at_most == sum(x <= n for x in lengths)
        assert r.tokens_below == sum(x for x in lengths if x < n) and r.tokens_at_least == sum(x for x in lengths if x >= n)
        assert r.truncated_total == sum(min(x, n) for x in lengths)
    for limit in (0, 1, 7, 500, 10**6):
        assert token_counts.truncated_total(hist, limit) == sum(min(x, limit) for x in lengths)
    assert token_counts.length_quantile(hist, 0.5) == lengths[-(-len(lengths) // 2) - 1]
    assert token_counts.length_histogram(token_counts.encoded_lengths(no_docs, RANKS, public_tokenizers.PATTERN)).count() == 0
