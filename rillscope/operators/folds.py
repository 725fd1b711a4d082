"""Choices in time order where each depends on the one before, made in ranges at once.

A candidate is kept or not depending on the one kept before it.  Whatever was
kept before a range of time matters only for the first candidate of the range
that follows it, and that is one of those in the range's first ``gap`` seconds
or the first one after them.  So each range says for each such entry where the
chain that starts there ends; one row per range and entry is all that a series'
single pass sees; then each range, told its entry, keeps its rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Seconds in a range: 64 days; many gaps long.
RANGE_S = 64 * 86_400.0


def successors(epoch: np.ndarray, sure: np.ndarray, gap: float) -> tuple[np.ndarray, np.ndarray]:
    """For each candidate the next one of its chain (n if none), and whether that one stands beside it rather than in its place.

    The next one is the first that is at least ``gap`` later or surer.
    """
    n = len(epoch)
    far = np.searchsorted(epoch, epoch + gap)
    # Differences decide, as they are exact; the sum above may be off by one place.
    back = np.maximum(far - 1, 0)
    far = np.where((far > 0) & (back > np.arange(n)) & (epoch[back] - epoch >= gap), back, far)
    at = np.minimum(far, n - 1)
    far = np.where((far < n) & (epoch[at] - epoch < gap), far + 1, far)
    surer = np.full(n, n)
    if n and sure.min() < sure.max():
        waiting: list[int] = []
        for i, c in enumerate(sure.tolist()):
            while waiting and sure[waiting[-1]] < c:
                surer[waiting.pop()] = i
            waiting.append(i)
    return np.minimum(far, surer), far <= surer


def chain_ends(nxt: np.ndarray) -> np.ndarray:
    """Where the chain from each candidate ends."""
    n = len(nxt)
    out = np.arange(n)
    for i in range(n - 1, -1, -1):
        if nxt[i] < n:
            out[i] = out[nxt[i]]
    return out


def kept_in_order(epoch: np.ndarray, sure: np.ndarray, gap: float, entry: int = 0, last_stays: bool = True) -> np.ndarray:
    """Places of the candidates that stay when the chain starts at ``entry``."""
    nxt, beside = successors(epoch, sure, gap)
    out, at, n = [], entry, len(epoch)
    while at < n:
        if nxt[at] >= n:
            if last_stays:
                out.append(at)
        elif beside[at]:
            out.append(at)
        at = int(nxt[at])
    return np.array(out, np.int64)


def _sorted(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    table = table.sort_by([("epoch", "ascending"), ("confidence", "ascending")])
    return table, table.column("epoch").to_numpy(), table.column("confidence").to_numpy()


ENTRIES = "series_id string, range bigint, entry bigint, epoch double, confidence double, end_epoch double, end_confidence double"
CARRIED = "series_id string, range bigint, entry bigint, last_stays boolean"


def _entries(table: pa.Table, gap: float, span: float, surest: bool) -> pa.Table:
    table, epoch, sure = _sorted(table)
    sure = sure if surest else np.zeros(len(sure))
    start = table.column("range")[0].as_py() * span
    ends = chain_ends(successors(epoch, sure, gap)[0])
    # Candidates that something before the range can reach past, and the first that nothing can.
    n = min(len(epoch), int(np.searchsorted(epoch, start + gap, side="right")) + 1)
    names = table.column("series_id")[:n], table.column("range")[:n]
    return pa.table([*names, np.arange(n), epoch[:n], sure[:n], epoch[ends[:n]], sure[ends[:n]]], names=[c.split()[0] for c in ENTRIES.split(", ")])


def _carry(table: pa.Table, gap: float) -> pa.Table:
    """One pass over the ranges of a series: where each range's chain starts (-1: nothing there goes on), and whether its last one stays."""
    table = table.sort_by([("range", "ascending"), ("entry", "ascending")])
    part, epoch, sure, end_epoch, end_sure = (table.column(c).to_numpy() for c in ("range", "epoch", "confidence", "end_epoch", "end_confidence"))
    edges = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True])))
    out: list[list] = []
    held: tuple[float, float] | None = None
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        at = a
        if held is not None:
            far, surer = epoch[a:b] - held[0] >= gap, sure[a:b] > held[1]
            go = np.flatnonzero(far | surer)
            if not len(go):
                out.append([part[a], -1, False])
                continue
            at = a + int(go[0])
            if not far[go[0]]:  # the one held gives way to a surer one
                next(o for o in reversed(out) if o[1] >= 0)[2] = False
        out.append([part[a], at - a, True])
        held = float(end_epoch[at]), float(end_sure[at])
    ranges, entries, stays = zip(*out, strict=True)
    return pa.table([pa.array([table.column("series_id")[0].as_py()] * len(out)), pa.array(ranges, pa.int64()), pa.array(entries, pa.int64()), pa.array(stays)], names=[c.split()[0] for c in CARRIED.split(", ")])


def keep_apart(candidates: DataFrame, gap: float, surest: bool = False, span: float = RANGE_S) -> DataFrame:
    """Candidates in time order, each at least ``gap`` seconds after the one kept before; with ``surest`` a surer one takes the place of the one kept before it."""
    span = max(span, 2.0 * gap)
    more = [c for c in ("algorithm",) if c in candidates.columns]
    rows = candidates.select("series_id", F.col("epoch").cast("double").alias("epoch"), F.col("confidence").cast("double").alias("confidence"), *more)
    names = rows.columns
    dealt = rows.withColumn("range", F.floor(F.col("epoch") / span))
    entries = dealt.groupBy("series_id", "range").applyInArrow(lambda t: _entries(t, gap, span, surest), ENTRIES)
    carried = entries.groupBy("series_id").applyInArrow(lambda t: _carry(t, gap), CARRIED)

    def keep(table: pa.Table) -> pa.Table:
        entry, stays = table.column("entry")[0].as_py(), table.column("last_stays")[0].as_py()
        table, epoch, sure = _sorted(table.select(names))
        places = kept_in_order(epoch, sure if surest else np.zeros(len(sure)), gap, entry, stays) if entry >= 0 else []
        return table.take(pa.array(places, pa.int64()))

    return dealt.join(carried, ["series_id", "range"]).groupBy("series_id", "range").applyInArrow(keep, rows.schema)
