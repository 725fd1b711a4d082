"""Operators over a stream whose rows come out of order, with one state per series.

Rows of a series wait in a list state until the watermark has passed them; an
event-time timer then takes them in time order through a step that carries a
value from row to row.  Rows behind the watermark are left out, since what
follows them has been given out already.  So a stream gives what the same step
gives over the sorted table, however its rows are dealt to batches, as long as
none is later than the delay.  A series without rows for ``idle`` is forgotten.

What waits is bounded by the delay and the rate of a series, the value by its step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: (series, rows in order, value or None) -> (rows to give out, value).
Step = Callable[[str, pd.DataFrame, tuple | None], tuple[pd.DataFrame, tuple]]

PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """List states and timers need this state store while a query starts; the session's own setting comes back."""
    key, value = PROVIDER
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class _Ordered(StatefulProcessor):
    def __init__(self, step: Step, columns: list[str], waiting: str, value: str, out: list[str], idle_ms: int | None):
        self.step, self.columns, self.waiting, self.value, self.out, self.idle_ms = step, columns, waiting, value, out, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", self.waiting)
        self.carried = handle.getValueState("carried", self.value)
        self.due = handle.getValueState("due", "at bigint")

    def _wake(self, at: int, sooner: bool) -> None:
        """Set the series' one timer; with ``sooner`` only if it is earlier than the one that is set."""
        set_ = self.due.get()
        if set_ is not None:
            if set_[0] == at or (sooner and set_[0] < at):
                return
            self.handle.deleteTimer(set_[0])
        self.handle.registerTimer(at)
        self.due.update((at,))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        for part in rows:
            part = part[part.epoch_us > passed] if passed > 0 else part
            if len(part):
                self.rows.appendList([tuple(r) for r in part[self.columns].astype(object).itertuples(index=False, name=None)])
                self._wake(int(-(-int(part.epoch_us.min()) // 1000)), True)
        yield pd.DataFrame(columns=self.out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = pd.DataFrame(list(self.rows.get()), columns=self.columns)
        self.due.clear()
        if not len(held):  # idle
            self.carried.clear()
            return
        ready, rest = held[held.epoch_us <= passed], held[held.epoch_us > passed]
        if len(ready):
            out, carried = self.step(key[0], ready.sort_values(["epoch_us", "seq"], kind="stable"), self.carried.get())
            self.carried.update(carried)
            yield out[self.out]
        if len(rest):
            self.rows.put([tuple(r) for r in rest.astype(object).itertuples(index=False, name=None)])
            self._wake(int(-(-int(rest.epoch_us.min()) // 1000)), False)
        else:
            self.rows.clear()
            if self.idle_ms:
                self._wake(passed // 1000 + self.idle_ms, False)


def in_order(stream: DataFrame, step: Step, columns: dict[str, str], value: str, out: str, late: str = "30 minutes", idle_seconds: int | None = None) -> DataFrame:
    """``step`` over each series of a stream in time order.

    ``stream`` has series_id, epoch_us, seq and ``columns`` (name: type); the
    step's rows have the columns ``out``, its value those of ``value``.
    """
    types = {"epoch_us": "bigint", "seq": "bigint"} | columns
    rows = stream.select("series_id", *types, F.timestamp_micros("epoch_us").alias("ts")).withWatermark("ts", late)
    names = [c.split()[0] for c in out.replace("array<", "").split(", ")]
    processor = _Ordered(step, list(types), ", ".join(f"{n} {t}" for n, t in types.items()), value, names, idle_seconds and idle_seconds * 1000)
    return rows.groupBy("series_id").transformWithStateInPandas(processor, out, "append", "EventTime")
