"""Batch sessions without a per-key sort of all rows.

Time is cut into buckets as long as the gap.  A pause longer than the gap can
only begin before the first event of a bucket, so sessions follow from one row
per ``(key, bucket)``: a bucket starts a session when the bucket before it is
empty or ended more than the gap earlier.  The window functions run over those
rows -- a key with a third of all events contributes one row per gap of time --
and events get their session by an equi-join on ``(key, bucket)``.  Events that
lie exactly a gap apart share a session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(event_time: str = "event_time") -> Column:
    return F.unix_micros(F.col(event_time).cast("timestamp"))


def bucket_of(t: Column, gap_us: int) -> Column:
    return F.floor(t / F.lit(gap_us)).cast("long")


def bucket_sessions(buckets: DataFrame, key: str, gap_us: int) -> DataFrame:
    """``buckets(key, __b, __lo, __hi, ...)`` plus ``__sid`` (the bucket that began the session),
    ``__start`` and ``__end`` (exclusive) of the session, in microseconds."""
    order = Window.partitionBy(key).orderBy("__b")
    begins = (F.lag("__b").over(order).isNull()
              | (F.lag("__b").over(order) != F.col("__b") - 1)
              | ((F.col("__lo") - F.lag("__hi").over(order)) > gap_us))
    flagged = buckets.withColumn("__begins", begins)
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    ids = flagged.withColumn("__sid", F.max(F.when(F.col("__begins"), F.col("__b"))).over(running)).drop("__begins")
    session = Window.partitionBy(key, "__sid")
    return (ids.withColumn("__start", F.min("__lo").over(session))
            .withColumn("__end", F.max("__hi").over(session) + F.lit(gap_us)))


def session_counts(df: DataFrame, key: str, gap_ms: int, sums: dict[str, Column]) -> DataFrame:
    """``key, window`` and each of ``sums`` (counts or sums, by output name) per session of ``key``."""
    gap_us = gap_ms * 1000
    buckets = (df.withColumn("__t", micros()).groupBy(key, bucket_of(F.col("__t"), gap_us).alias("__b"))
               .agg(F.min("__t").alias("__lo"), F.max("__t").alias("__hi"), *[c.alias(n) for n, c in sums.items()]))
    return (bucket_sessions(buckets, key, gap_us).groupBy(key, "__start", "__end")
            .agg(*[F.sum(n).alias(n) for n in sums]).select(key, session_struct().alias("window"), *sums))


def session_struct() -> Column:
    return F.struct(F.timestamp_micros("__start").alias("start"), F.timestamp_micros("__end").alias("end"))
