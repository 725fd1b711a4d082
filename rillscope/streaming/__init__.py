"""Incremental forms of the operators that have one."""

from .minima import stream_min_intervals, stream_to_table
from .ordered import in_order
from .state import stream_change_points, stream_congestion, stream_jitter

__all__ = ["in_order", "stream_change_points", "stream_congestion", "stream_jitter", "stream_min_intervals", "stream_to_table"]
