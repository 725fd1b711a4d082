"""Jitter, congestion and change points of a stream: the steps that carry a value of each series on."""

from __future__ import annotations

from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import online
from .ordered import in_order


def _jitter(series_id: str, rows: pd.DataFrame, last: tuple | None) -> tuple[pd.DataFrame, tuple]:
    before = rows.rtt_value.shift(1)
    if last is not None:
        before.iloc[0] = last[0]
    out = pd.DataFrame({"series_id": series_id, "epoch_us": rows.epoch_us, "seq": rows.seq, "jitter": rows.rtt_value - before})
    return out[out.jitter.notna()], (float(rows.rtt_value.iloc[-1]),)


def stream_jitter(samples: DataFrame, late: str = "30 minutes", idle_seconds: int | None = None) -> DataFrame:
    """(series_id, epoch_us, seq, jitter) of a stream of samples that may come ``late``."""
    return in_order(samples, _jitter, {"rtt_value": "double"}, "last double", "series_id string, epoch_us bigint, seq bigint, jitter double", late, idle_seconds)


def _congestion(series_id: str, rows: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple]:
    mark = pd.Series(pd.NA, index=rows.index, dtype="boolean").mask(~rows.has_jump.astype(bool), False).mask(rows.has_jump.astype(bool) & rows.has_significant_jitter.astype(bool), True)
    now = mark.ffill().fillna(bool(state[0]) if state is not None else False).astype(bool)
    out = pd.DataFrame({"series_id": series_id, "cp_idx": rows.cp_idx.astype("int64"), "start_epoch": rows.start_epoch, "is_congested": now})
    return out, (bool(now.iloc[-1]),)


def stream_congestion(evidence: DataFrame, late: str = "30 minutes", idle_seconds: int | None = None) -> DataFrame:
    """(series_id, cp_idx, start_epoch, is_congested) of a stream of periods: a jump with jitter sets the state, no jump resets it, a jump alone holds it."""
    rows = evidence.withColumns({"epoch_us": F.round(F.col("start_epoch") * 1e6).cast("bigint"), "seq": F.col("cp_idx").cast("bigint"), "cp_idx": F.col("cp_idx").cast("bigint")})
    columns = {"cp_idx": "bigint", "start_epoch": "double", "has_jump": "boolean", "has_significant_jitter": "boolean"}
    return in_order(rows, _congestion, columns, "congested boolean", "series_id string, cp_idx bigint, start_epoch double, is_congested boolean", late, idle_seconds)


def stream_change_points(series: DataFrame, late: str = "30 minutes", settings: online.Settings | None = None, idle_seconds: int | None = None) -> DataFrame:
    """(series_id, epoch, confidence, detected_epoch) of a stream of samples or minima, as soon as a change is settled."""
    rows = series if "seq" in series.columns else series.withColumn("seq", F.lit(0).cast("bigint"))
    return in_order(rows, partial(online.online_step, settings or online.Settings()), {"rtt_value": "double"}, online.STATE, online.OUT, late, idle_seconds)
