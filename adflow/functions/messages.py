"""Result messages as text (the job's sink payloads).

Fixed formats of the reference job (they are not valid JSON, on purpose):
    join      {campaign_id: %s, ad_id: %s, ts_clicked: %d}
    aggregate {campaign_id: %s, count: %d, window: %d}
    event     {ts:%d, id:%s, et:%s}
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adflow.operators.windows import end_ms

JOIN_FORMAT = "{campaign_id: %s, ad_id: %s, ts_clicked: %d}"
AGGREGATE_FORMAT = "{campaign_id: %s, count: %d, window: %d}"
EVENT_FORMAT = "{ts:%d, id:%s, et:%s}"


def _s(c: str) -> Column:
    # Java's %s prints null as "null"
    return F.coalesce(F.col(c).cast("string"), F.lit("null"))


def join_message(df: DataFrame) -> DataFrame:
    return df.select(F.format_string(JOIN_FORMAT, _s("campaign_id"), _s("ad_id"),
                                     F.col("ts_clicked")).alias("value"))


def aggregate_message(df: DataFrame) -> DataFrame:
    """``(campaign_id, count, window_end)`` or ``(campaign_id, count, window)`` -> text."""
    window_end = F.col("window_end") if "window_end" in df.columns else end_ms("window")
    return df.select(F.format_string(AGGREGATE_FORMAT, _s("campaign_id"), F.col("count"),
                                     window_end).alias("value"))


def event_message(df: DataFrame) -> DataFrame:
    return df.select(F.format_string(EVENT_FORMAT, F.col("ts"), _s("ad_id"), _s("et"))
                     .alias("value"))
