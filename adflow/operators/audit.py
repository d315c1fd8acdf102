"""Late-row audit: which records a 1-second-bounded watermark would drop.

Per source partition, in offset order, the watermark before a record is the
largest event time seen earlier minus the delay.  A record is late when the
last window it belongs to had already ended at that watermark (window end <=
watermark), i.e. every window it could count in was closed.  For session
windows the record's own window ``[t, t + gap)`` is used.

The running max is a two-level block scan (see :mod:`adflow.operators.scan`),
so a partition with a third of all records is still split across tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adflow.config import validate_window
from adflow.operators.scan import running_max_before
from adflow.operators.windows import slide_of

DEFAULT_BLOCK = 1 << 20  # offsets per block


def last_window_end(ts: Column, kind: str, size_ms: int) -> Column:
    """End (exclusive, epoch ms) of the latest window holding an event at ``ts`` ms."""
    validate_window(kind, size_ms)
    if kind == "tumbling":
        return (F.floor(ts / size_ms) + 1) * size_ms
    if kind == "sliding":
        d = slide_of(size_ms)
        return F.floor(ts / d) * d + size_ms
    return ts + size_ms


def late_audit(df: DataFrame, delay_ms: int, kind: str, size_ms: int,
               partition: str = "partition", offset: str = "offset", ts: str = "ts",
               block: int = DEFAULT_BLOCK) -> DataFrame:
    """Adds ``window_end``, ``watermark`` (null before the first record) and ``late``."""
    scanned = running_max_before(df, [partition], offset, ts, block, out="__prev_max")
    wm = F.col("__prev_max") - F.lit(delay_ms)
    end = last_window_end(F.col(ts), kind, size_ms).cast("long")
    return (scanned.withColumn("window_end", end)
            .withColumn("watermark", wm)
            .withColumn("late", F.coalesce(F.col("window_end") <= F.col("watermark"), F.lit(False)))
            .drop("__prev_max"))
