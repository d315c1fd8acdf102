"""Event-time windows: tumbling, sliding (slide = size / 5) and session (gap = size).

All windows are epoch-aligned and measured in milliseconds; the window end is
reported in epoch milliseconds, exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adflow.config import validate_window


def slide_of(size_ms: int) -> int:
    return size_ms // 5


def window_column(kind: str, size_ms: int, time_col: str | Column = "event_time") -> Column:
    validate_window(kind, size_ms)
    t = F.col(time_col) if isinstance(time_col, str) else time_col
    if kind == "tumbling":
        return F.window(t, f"{size_ms} milliseconds")
    if kind == "sliding":
        return F.window(t, f"{size_ms} milliseconds", f"{slide_of(size_ms)} milliseconds")
    return F.session_window(t, f"{size_ms} milliseconds")


def assign_window(df: DataFrame, kind: str, size_ms: int, time_col: str = "event_time",
                  name: str = "window") -> DataFrame:
    """Add a window struct column (tumbling/sliding expand rows; session is an aggregate key)."""
    return df.withColumn(name, window_column(kind, size_ms, time_col))


def end_ms(window: str | Column = "window") -> Column:
    w = F.col(window) if isinstance(window, str) else window
    return F.unix_millis(w.getField("end"))


def start_ms(window: str | Column = "window") -> Column:
    w = F.col(window) if isinstance(window, str) else window
    return F.unix_millis(w.getField("start"))


def ms_to_time(ms: str | Column) -> Column:
    c = F.col(ms) if isinstance(ms, str) else ms
    return F.timestamp_millis(c)
