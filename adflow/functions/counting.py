"""What an operator skips, as counts that come back with its result (``DataFrame.observe``: no pass of their own)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def counted(df: DataFrame, to: str | Observation | None, **conditions: Column) -> DataFrame:
    """``df``, whose rows are counted as they pass: ``rows``, and for each name those that meet its condition.

    Rows that the query does not need do not pass: count with an action that reads the result.
    ``to`` is an ``Observation`` (batch: read ``.get`` after the action) or a name
    (streams: see :class:`adflow.streaming.trace.Trace`); with ``None`` nothing is counted.
    """
    if to is None:
        return df
    counters = [F.count(F.lit(1)).alias("rows")]
    counters += [F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long")).alias(n) for n, c in conditions.items()]
    return df.observe(to, *counters)
