"""Minimum-cost repair of the roles of conversations, and rendering.

*Automaton.*  A legal chat is an optional system turn, then user and assistant
turns in alternation, ending with the assistant.  States: start, after system,
after user, after assistant.

*Edits.*  A turn is kept, relabelled to another role, or merged into the turn
before it; an empty turn may be inserted anywhere.  The cheapest sequence of
edits (COSTS) that the automaton accepts is found by dynamic programming; among
equal costs the first of EDITS order wins.

*Scale.*  The step of a turn is a min-plus matrix over the four states, and such
matrices multiply associatively.  So a conversation, however long, is cut into
segments of at most SEGMENT turns by a range partition over (conv_id, turn);
segments' products are combined (again in groups) to the states at segment
borders, and each segment is then traced back on its own.

*Output.*  One row for each turn that was read or inserted, with the text it
adds to the rendering; the rows of a conversation in the order of (position,
sub) concatenate to the rendered chat.

Edge cases: a null conv_id is a conversation of its own; a null turn sorts
first, ties by role and text; null texts are empty; a role that is not known
(or null) costs UNKNOWN to label; repeated turns are kept; an empty table gives
an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
#: Role (as its state) that may follow each state.
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
COSTS = {"keep": 0, "merge": 1, "relabel": 2, "insert": 3}
UNKNOWN = 1
SEGMENT = 512
GROUP = 512
FAR = 1 << 40


def _closure() -> np.ndarray:
    """Cost of the inserted turns that lead from one state to another."""
    d = np.full((4, 4), FAR, np.int64)
    np.fill_diagonal(d, 0)
    for s, after in NEXT.items():
        for t in after:
            d[s, t] = COSTS["insert"]
    for k in range(4):
        d = np.minimum(d, d[:, k : k + 1] + d[k : k + 1, :])
    return d


INSERT = _closure()


def role_state(role: str | None) -> int:
    """The state that a role leads to; START for a role that is not known."""
    name = (role or "").strip().lower()
    return ROLES.index(name) + 1 if name in ROLES else START


def _label(state: int, to: int) -> int:
    return 0 if state == to else UNKNOWN if state == START else COSTS["relabel"]


def turn_edits(state: int) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, edit) of all ways to take a turn of role ``state``."""
    out = []
    for s, after in NEXT.items():
        for t in after:
            out.append((s, t, _label(state, t), "keep" if t == state else "relabel"))
        if s != START:
            out.append((s, s, COSTS["merge"] + _label(state, s), "merge"))
    return out


EDITS = {state: turn_edits(state) for state in range(4)}


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-plus product."""
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), FAR)


def _step(state: int) -> np.ndarray:
    m = np.full((4, 4), FAR, np.int64)
    for s, t, cost, _ in EDITS[state]:
        m[s, t] = min(m[s, t], cost)
    return times(INSERT, m)


STEPS = [_step(state) for state in range(4)]


def trace(states: list[int], begin: int, end: int) -> list[tuple[int, list[int], str, int]]:
    """The cheapest edits of turns from state ``begin`` to ``end``.

    For each turn: its number, the turns inserted before it, its edit and the
    state after it.
    """
    costs = [np.where(np.arange(4) == begin, 0, FAR)]
    for s in states:
        costs.append(np.minimum((costs[-1][:, None] + STEPS[s]).min(axis=0), FAR))
    out, at = [], end
    for i in range(len(states) - 1, -1, -1):
        want = costs[i + 1][at]
        for p, s, (f, t, cost, edit) in ((p, f, e) for e in EDITS[states[i]] for f in (e[0],) for p in range(4)):
            if t == at and costs[i][p] + INSERT[p, s] + cost == want:
                out.append((i, path(p, f), edit, at))
                at = p
                break
        else:
            raise ValueError("no edits lead there")
    return out[::-1]


def path(begin: int, end: int) -> list[int]:
    """The turns to insert between two states."""
    out = []
    while begin != end:
        begin = next(t for t in NEXT[begin] if INSERT[begin, t] + INSERT[t, end] == INSERT[begin, end])
        out.append(begin)
    return out


SEGMENT_SCHEMA = "kind int, conv_id bigint, part int, seg int, row int, role string, text string, n bigint, product array<bigint>"


def _segments(turns: DataFrame) -> DataFrame:
    """Rows of turns (kind 0) with their segment, and a row with the product of each segment (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seg, held, now, product = TaskContext.get().partitionId(), -1, 0, object(), None

        def close() -> dict:
            return {"kind": 1, "conv_id": now, "part": part, "seg": seg, "n": held, "product": product.reshape(-1).tolist()}

        schema = pa.schema([("kind", pa.int32()), ("conv_id", pa.int64()), ("part", pa.int32()), ("seg", pa.int32()), ("row", pa.int32()), ("role", pa.string()), ("text", pa.string()), ("n", pa.int64()), ("product", pa.list_(pa.int64()))])
        for b in batches:
            out = []
            for conv, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if seg < 0 or conv != now or held >= SEGMENT:
                    if seg >= 0:
                        out.append(close())
                    seg, held, now, product = seg + 1, 0, conv, INSERT * 0 + np.where(np.eye(4, dtype=bool), 0, FAR)
                out.append({"kind": 0, "conv_id": conv, "part": part, "seg": seg, "row": held, "role": role, "text": text})
                product = times(product, STEPS[role_state(role)])
                held += 1
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if seg >= 0:
            yield pa.RecordBatch.from_pylist([close()], schema=schema)

    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text")]
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Ranges end inside a long conversation, so no task gets more of it than of others.
    return turns.repartitionByRange(n, *order).sortWithinPartitions(*order).select("conv_id", "role", "text").mapInArrow(run, SEGMENT_SCHEMA)


def _solve(rows: list[dict], begin: int | None, end: int | None) -> list[tuple[int, int]]:
    """States before and after each of a run of products; ``begin`` and ``end`` are those of the run."""
    mats = [np.array(r["product"], np.int64).reshape(4, 4) for r in rows]
    costs = [np.where(np.arange(4) == begin, 0, FAR)]
    for m in mats:
        costs.append(np.minimum((costs[-1][:, None] + m).min(axis=0), FAR))
    at = int(np.argmin(np.minimum(costs[-1] + INSERT[:, ASSISTANT], FAR))) if end is None else end
    out = []
    for i in range(len(mats) - 1, -1, -1):
        p = int(np.argmin(costs[i] + mats[i][:, at]))
        out.append((p, at))
        at = p
    return out[::-1]


BORDERS = "conv_id bigint, part int, seg int, position bigint, begin int, end int, last boolean"
BORDERS_ARROW = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("seg", pa.int32()), ("position", pa.int64()), ("begin", pa.int32()), ("end", pa.int32()), ("last", pa.bool_())])


def _solved(rows: list[dict]) -> list[dict]:
    """The borders of a run of segments in order."""
    first = rows[0]
    known = first.get("begin") is not None
    found = _solve(rows, first["begin"] if known else START, first.get("end") if known else None)
    at, out = first.get("position") or 0, []
    for i, (r, (a, b)) in enumerate(zip(rows, found, strict=True)):
        out.append({"conv_id": r["conv_id"], "part": r["part"], "seg": r["seg"], "position": at, "begin": a, "end": b, "last": i == len(rows) - 1 and first.get("last") is not False})
        at += r["n"]
    return out


def _in_order(segments: DataFrame, *keys: str) -> DataFrame:
    """:func:`_solved` for each run of equal ``keys``, all of a task in one pass over its sorted rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        now: tuple = ()
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                key = tuple(r[k] for k in keys)
                if held and key != now:
                    out += _solved(held)
                    held = []
                now = key
                held.append(r)
            yield pa.RecordBatch.from_pylist(out, schema=BORDERS_ARROW)
        if held:
            yield pa.RecordBatch.from_pylist(_solved(held), schema=BORDERS_ARROW)

    n = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return segments.repartition(n, *keys).sortWithinPartitions(*(F.asc_nulls_first(k) for k in (*keys, "part", "seg"))).mapInArrow(run, BORDERS)


def _borders(segments: DataFrame) -> DataFrame:
    """(conv_id, part, seg, position, begin, end, last) of every segment.

    Conversations of more than GROUP segments are first combined in groups.
    """
    spark = segments.sparkSession

    long = segments.groupBy("conv_id").agg(F.count("*").alias("c")).where(F.col("c") > GROUP)
    if long.isEmpty():
        return _in_order(segments, "conv_id")

    # A long conversation's segments are numbered through by partition, then combined GROUP at a time.
    per_part = segments.groupBy("conv_id", "part").agg(F.count("*").alias("c"), F.min("seg").alias("low"))
    from pyspark.sql import Window

    before = F.coalesce(F.sum("c").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = segments.join(per_part.select(F.col("conv_id").alias("k"), F.col("part").alias("p"), "low", before.alias("before")), F.col("conv_id").eqNullSafe(F.col("k")) & (F.col("part") == F.col("p"))).withColumn("group", F.floor((F.col("before") + F.col("seg") - F.col("low")) / GROUP).cast("int")).drop("k", "p", "low", "before")
    numbered = materialize(spark, numbered, "segments")

    def combine(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["part"], r["seg"]))
        product = np.where(np.eye(4, dtype=bool), 0, FAR)
        for r in rows:
            product = times(product, np.array(r["product"], np.int64).reshape(4, 4))
        return pa.table({"conv_id": pa.array([rows[0]["conv_id"]], pa.int64()), "part": pa.array([0], pa.int32()), "seg": pa.array([rows[0]["group"]], pa.int32()), "n": pa.array([sum(r["n"] for r in rows)], pa.int64()), "product": pa.array([product.reshape(-1).tolist()], pa.list_(pa.int64()))})

    upper = materialize(spark, numbered.groupBy("conv_id", "group").applyInArrow(combine, "conv_id bigint, part int, seg int, n bigint, product array<bigint>"), "segments")
    known = _borders(upper).select(F.col("conv_id").alias("k"), F.col("seg").alias("g"), "position", "begin", "end", "last")
    inner = numbered.join(known, F.col("conv_id").eqNullSafe(F.col("k")) & (F.col("group") == F.col("g"))).drop("k", "g")
    return _in_order(inner, "conv_id", "group")


def render(role: int, text: str, edit: str, opened: bool) -> str:
    """What a turn adds to the rendered chat; ``opened``: a turn before it is still open."""
    if edit == "merge":
        return f"\n{text}"
    return ("<|end|>\n" if opened else "") + f"<|{ROLES[role - 1]}|>\n{text}"


def repaired_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, position, sub, role, text, edit, cost, rendered) of all repaired turns."""
    spark = conversations.sparkSession
    turns = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    cut = materialize(spark, _segments(turns), "segments", "kind")
    borders = _borders(cut.where("kind = 1").select("conv_id", "part", "seg", "n", "product"))
    rows = cut.where("kind = 0").select("part", "seg", "row", F.col("conv_id"), "role", "text")
    joined = rows.join(borders.drop("conv_id"), ["part", "seg"])

    def finish(table: pa.Table) -> pa.Table:
        found = sorted(table.to_pylist(), key=lambda r: r["row"])
        head = found[0]
        begin, end, at = head["begin"], head["end"], head["position"]
        states = [role_state(r["role"]) for r in found]
        out = []

        def add(position: int, sub: int, state: int, text: str, edit: str, cost: int, opened: bool) -> None:
            out.append({"conv_id": head["conv_id"], "position": position, "sub": sub, "role": ROLES[state - 1], "text": text, "edit": edit, "cost": cost, "rendered": render(state, text, edit, opened)})

        opened = begin != START
        for i, inserted, edit, state in trace(states, begin, end):
            for sub, s in enumerate(inserted):
                add(at + i, sub, s, "", "insert", COSTS["insert"], opened)
                opened = True
            cost = _label(states[i], state) + (COSTS["merge"] if edit == "merge" else 0)
            add(at + i, len(inserted), state, found[i]["text"] or "", edit, cost, opened)
            opened = True
        if head["last"]:
            for sub, s in enumerate(path(end, ASSISTANT)):
                add(at + len(found), sub, s, "", "insert", COSTS["insert"], opened)
            out[-1]["rendered"] += "<|end|>\n"
        return pa.Table.from_pylist(out, schema=pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("sub", pa.int32()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string()), ("cost", pa.int64()), ("rendered", pa.string())]))

    return joined.groupBy("part", "seg").applyInArrow(finish, "conv_id bigint, position bigint, sub int, role string, text string, edit string, cost bigint, rendered string")
