"""Finding keys that several documents share, without sending a key twice from a block.

Blocks send each distinct key with the least ``doc_id`` that has it there;
shards (by key) find the least over all blocks and answer the blocks.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import pack, unpack

ASK, ANSWER = 1, 2
SCHEMA = "block bigint, kind int, shard int, n bigint, sum bigint, keys binary, owners binary, flags binary"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
ARROW = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("shard", pa.int32()), ("n", pa.int64()), ("sum", pa.int64()), ("keys", pa.binary()), ("owners", pa.binary()), ("flags", pa.binary())])


def distinct_keys(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys by (shard, key), the place of each key among them, and the shards' bounds."""
    uniq, which = np.unique(keys, return_inverse=True)
    shard = (uniq % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return uniq[order], place[which.reshape(-1)], np.searchsorted(shard[order], np.arange(shards + 1))


def asked(block: int, keys: np.ndarray, place: np.ndarray, bounds: np.ndarray, doc_ids: np.ndarray) -> list[dict]:
    """Rows that ask for a block's distinct keys; ``doc_ids`` belongs to the places."""
    low = np.full(len(keys), np.iinfo(np.int64).max)
    high = np.full(len(keys), np.iinfo(np.int64).min)
    np.minimum.at(low, place, doc_ids)
    np.maximum.at(high, place, doc_ids)
    several = (low != high).astype(np.uint8)
    out, check = [], checksum(keys)
    for s in np.flatnonzero(np.diff(bounds)).tolist():
        a, b = bounds[s], bounds[s + 1]
        out.append({"block": block, "kind": ASK, "shard": s, "n": int(b - a), "sum": check, "keys": pack(keys[a:b]), "owners": pack(low[a:b]), "flags": pack(several[a:b])})
    return out


def checksum(keys: np.ndarray) -> int:
    """Of a block's distinct keys; it comes back with the answers."""
    return zlib.crc32(keys.tobytes())


def _answer(table: pa.Table, with_keys: bool) -> pa.Table:
    rows = [dict(zip(NAMES, r, strict=True)) for r in zip(*(table.column(c).to_pylist() for c in NAMES), strict=True)]
    sizes = [r["n"] for r in rows]
    keys = np.concatenate([unpack(r["keys"], r["n"], np.uint64) for r in rows])
    owners = np.concatenate([unpack(r["owners"], r["n"], np.int64) for r in rows])
    several = np.concatenate([unpack(r["flags"], r["n"], np.uint8) for r in rows])
    order = np.argsort(keys, kind="stable")
    asked_keys, keys = keys if with_keys else None, keys[order]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(keys))))
    del keys
    low, high = np.minimum.reduceat(owners[order], starts), np.maximum.reduceat(owners[order], starts)
    shared = (low != high) | (np.maximum.reduceat(several[order], starts) > 0)
    flags, least = np.empty(len(order), np.uint8), np.empty(len(order), np.int64)
    flags[order], least[order] = shared[group], low[group]
    out, at = [], 0
    for r, n in zip(rows, sizes, strict=True):
        f = flags[at : at + n]
        if f.any():
            out.append({"block": r["block"], "kind": ANSWER, "shard": r["shard"], "n": n, "sum": r["sum"], "keys": pack(asked_keys[at : at + n][f > 0]) if with_keys else None, "owners": pack(least[at : at + n][f > 0]), "flags": pack(f)})
        at += n
    return pa.Table.from_pylist(out, schema=ARROW)


def exchanged(asks: DataFrame, with_keys: bool = False) -> DataFrame:
    """The answers to all asks, with the shared keys if wanted; blocks without a shared key in a shard get none from it."""
    return asks.groupBy("shard").applyInArrow(lambda table: _answer(table, with_keys), SCHEMA)


def answers(rows: list[dict], total: int, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a block's distinct keys: whether each is shared, and its least ``doc_id``."""
    shared, least = np.zeros(total, bool), np.zeros(total, np.int64)
    for r in rows:
        if r["kind"] == ANSWER:
            a = bounds[r["shard"]]
            f = unpack(r["flags"], r["n"], np.uint8) > 0
            part = np.zeros(r["n"], np.int64)
            part[f] = unpack(r["owners"], int(f.sum()), np.int64)
            shared[a : a + r["n"]], least[a : a + r["n"]] = f, part
    return shared, least
