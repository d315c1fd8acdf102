"""Windowed view x click join on ad id (tumbling, sliding, session).

Output rows are ``(campaign_id, ad_id, ts_clicked, window)``: campaign and ad of
the view, time of the click, and the shared window.  Every view x click pair
sharing a window is emitted, once per window it shares (sliding windows give a
pair up to five times).  ``event_time`` of a pair is the last instant of its
window, so a second windowed stage can follow.

Session windows are formed over both sides together per ad id (a co-group over
the tagged union); a session holding only one side gives nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adflow.config import validate_window
from adflow.operators.sessions import bucket_of, bucket_sessions, micros, session_struct
from adflow.operators.windows import window_column

JOIN_COLUMNS = ("campaign_id", "ad_id", "ts_clicked", "window")


def _pair_time(df: DataFrame, native: bool = True) -> DataFrame:
    """Pair event time = last instant of its window (window end - 1 microsecond)."""
    if native:
        return df.withColumn("event_time", F.window_time("window"))
    return df.withColumn("event_time", _last_instant())


def _last_instant() -> Column:
    return F.col("window.end") - F.expr("INTERVAL 1 MICROSECOND")


def hot_ads(events: DataFrame, share: float = 0.05) -> DataFrame:
    """``ad_id`` of the ads that hold more than ``share`` of the events (at most ``1 / share`` of them)."""
    per_ad = events.groupBy("ad_id").agg(F.count(F.lit(1)).alias("n"))
    return per_ad.where(F.col("n") > share * events.select(F.count(F.lit(1)).alias("n")).scalar()).select("ad_id")


def _dealt(df: DataFrame, hot: DataFrame, own: str, other: str, cells: int) -> DataFrame:
    """``df`` with its place in the grid of cells: one number by hash in ``own``, a copy for each number in ``other``.

    Rows of ads that are not hot lie in cell (0, 0) alone.
    """
    marked = df.join(hot.select("ad_id", F.lit(True).alias("__hot")), "ad_id", "left")
    number = F.pmod(F.xxhash64("ts", "event_time"), F.lit(cells)).cast("int")
    is_hot = F.col("__hot").isNotNull()
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(cells - 1))).otherwise(F.array(F.lit(0)))
    return (marked.withColumn(own, F.when(is_hot, number).otherwise(F.lit(0)))
            .withColumn(other, F.explode(copies)).drop("__hot"))


def window_join(views: DataFrame, clicks: DataFrame, kind: str, size_ms: int, hot: DataFrame | None = None,
                cells: int = 8) -> DataFrame:
    """``views``: (campaign_id, ad_id, ts, event_time); ``clicks``: (ad_id, ts, event_time).

    Streams have no run-time splitting of a hot key.  With ``hot`` (see
    :func:`hot_ads`; fixed for the life of a stream) the events of those ads are
    dealt over a grid of ``cells`` x ``cells`` by hashes of their own: a view has its
    row and is copied along it, a click its column.  Each pair meets in one cell,
    a cell holds ``1 / cells`` of either side, and state grows by ``cells`` for these
    ads alone.  (Tumbling and sliding; a session of an ad is one key.)
    """
    validate_window(kind, size_ms)
    place = []
    if hot is not None:
        if kind == "session":
            raise ValueError("hot ads are dealt out for tumbling and sliding windows")
        place = ["__row", "__column"]
        views, clicks = _dealt(views, hot, "__row", "__column", cells), _dealt(clicks, hot, "__column", "__row", cells)
    if kind == "session":
        if views.isStreaming or clicks.isStreaming:
            return session_join_stream(views, clicks, size_ms)
        return session_join_bucketed(views, clicks, size_ms)
    v = views.select("ad_id", "campaign_id", *place,
                     window_column(kind, size_ms).alias("window"))
    c = clicks.select("ad_id", F.col("ts").alias("ts_clicked"), *place,
                      window_column(kind, size_ms).alias("window"))
    pairs = v.join(c, on=["ad_id", "window", *place], how="inner")
    return _pair_time(pairs.select(*JOIN_COLUMNS))


def _tagged_union(views: DataFrame, clicks: DataFrame) -> DataFrame:
    v = views.select("ad_id", "campaign_id", "ts", "event_time",
                     F.lit(True).alias("is_view"))
    c = clicks.select("ad_id", F.lit(None).cast("string").alias("campaign_id"), "ts",
                      "event_time", F.lit(False).alias("is_view"))
    return v.unionByName(c)


def session_join_grouped(views: DataFrame, clicks: DataFrame, gap_ms: int) -> DataFrame:
    """The literal plan: one row per ad and session with its views and clicks as lists, then two explodes.

    For checks on small input: a row holds a whole session.
    """
    sessions = _tagged_union(views, clicks).groupBy(
        "ad_id", F.session_window("event_time", f"{gap_ms} milliseconds").alias("window")
    ).agg(
        F.collect_list(F.when(F.col("is_view"), F.col("campaign_id"))).alias("__v"),
        F.collect_list(F.when(~F.col("is_view"), F.col("ts"))).alias("__c"),
    )
    pairs = (
        sessions.where((F.size("__v") > 0) & (F.size("__c") > 0))
        .select("ad_id", "window", F.explode("__v").alias("campaign_id"), "__c")
        .select("campaign_id", "ad_id", F.explode("__c").alias("ts_clicked"), "window")
    )
    return _pair_time(pairs)


def session_join_stream(views: DataFrame, clicks: DataFrame, gap_ms: int) -> DataFrame:
    """Stream form: open sessions in map state of bounded rows (:mod:`adflow.streaming.session_pairs`)."""
    from adflow.streaming.session_pairs import session_pairs
    return session_pairs(_tagged_union(views, clicks), gap_ms).withColumn("event_time", _last_instant())


def session_join_bucketed(views: DataFrame, clicks: DataFrame, gap_ms: int) -> DataFrame:
    """Batch session join over event time: sessions and their bounds come from the
    ``(ad, bucket)`` table (:mod:`adflow.operators.sessions`) and are carried into an
    equi-join on ``(ad, session)``, whose hot sessions adaptive execution can split."""
    gap_us = gap_ms * 1000
    u = _tagged_union(views, clicks).withColumn("__t", micros())
    u = u.withColumn("__b", bucket_of(F.col("__t"), gap_us))
    buckets = u.groupBy("ad_id", "__b").agg(F.min("__t").alias("__lo"), F.max("__t").alias("__hi"))
    ids = bucket_sessions(buckets, "ad_id", gap_us).select("ad_id", "__b", "__sid", "__start", "__end")
    assigned = u.join(ids, ["ad_id", "__b"])
    v = assigned.where(F.col("is_view")).select("ad_id", "campaign_id", "__sid", "__start", "__end")
    c = assigned.where(~F.col("is_view")).select("ad_id", "__sid", F.col("ts").alias("ts_clicked"))
    out = v.join(c, ["ad_id", "__sid"]).select("campaign_id", "ad_id", "ts_clicked", session_struct().alias("window"))
    return _pair_time(out, native=False)
