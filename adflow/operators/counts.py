"""Counts per campaign and event-time window -> ``(campaign_id, count, window_end)``.

``window_end`` is the exclusive end of the window in epoch milliseconds.
Counting is a partial + final aggregate (no buffering of window contents).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adflow.config import validate_window
from adflow.operators.enrich import UNKNOWN, enrich
from adflow.operators.joins import window_join
from adflow.operators.sessions import session_counts
from adflow.operators.windows import end_ms, window_column

COUNT_COLUMNS = ("campaign_id", "count", "window_end")


def count_by_campaign(df: DataFrame, kind: str, size_ms: int,
                      weight: str | None = None) -> DataFrame:
    """Window count per campaign over ``event_time`` (rows may carry a ``weight``).

    Batch sessions are counted per ``(campaign, gap-long bucket)`` first, so a
    campaign with a third of all rows (all misses are one) is spread over its
    buckets; streams use Spark's session window, which keeps one state row per
    open session.
    """
    validate_window(kind, size_ms)
    agg = F.count(F.lit(1)) if weight is None else F.sum(weight)
    if kind == "session" and not df.isStreaming:
        out = session_counts(df, "campaign_id", size_ms, {"count": agg})
    else:
        out = df.groupBy(window_column(kind, size_ms).alias("window"), "campaign_id").agg(agg.alias("count"))
    return out.select("campaign_id", F.col("count").cast("long").alias("count"), end_ms("window").alias("window_end"))


def count_views(views: DataFrame, campaigns: DataFrame, kind: str, size_ms: int,
                unknown: str = UNKNOWN) -> DataFrame:
    """Views per campaign and window from un-enriched views ``(ad_id, ts, event_time)``."""
    return count_by_campaign(enrich(views, campaigns, unknown), kind, size_ms)


def count_joined(views: DataFrame, clicks: DataFrame, campaigns: DataFrame,
                 kind: str, size_ms: int, unknown: str = UNKNOWN) -> DataFrame:
    """Joined view x click pairs per campaign and window, without building the pairs.

    The pairs of an ad in a join window number ``views x clicks`` and all carry
    the window's last instant as event time, so counting views and clicks per
    ``(ad_id, join window)`` over the tagged union (one shuffle, partial
    aggregation absorbs hot ads) and summing the products in the second window
    stage is exact.  The campaign of a pair is the campaign of its view's ad,
    so the lookup runs on the per-ad aggregate.  Works on batch and streams.
    """
    v = views.select("ad_id", "event_time", F.lit(1).alias("__v"), F.lit(0).alias("__c"))
    c = clicks.select("ad_id", "event_time", F.lit(0).alias("__v"), F.lit(1).alias("__c"))
    return _count_tagged(v.unionByName(c), campaigns, kind, size_ms, unknown)


def count_joined_events(events: DataFrame, campaigns: DataFrame, kind: str, size_ms: int,
                        view: str = "view", click: str = "click", unknown: str = UNKNOWN) -> DataFrame:
    """:func:`count_joined` from one event stream ``(ad_id, et, event_time)``: a
    single scan filtered to ``et IN (view, click)`` instead of reading the source
    once per side."""
    tagged = events.where(F.col("et").isin(view, click)).select(
        "ad_id", "event_time",
        (F.col("et") == view).cast("int").alias("__v"),
        (F.col("et") == click).cast("int").alias("__c"))
    return _count_tagged(tagged, campaigns, kind, size_ms, unknown)


def _count_tagged(u: DataFrame, campaigns: DataFrame, kind: str, size_ms: int, unknown: str) -> DataFrame:
    validate_window(kind, size_ms)
    views, clicks = F.sum("__v").cast("long"), F.sum("__c").cast("long")
    if kind == "session" and not u.isStreaming:
        per_ad = session_counts(u, "ad_id", size_ms, {"__nv": views, "__nc": clicks})
    else:
        per_ad = u.groupBy("ad_id", window_column(kind, size_ms).alias("window")).agg(
            views.alias("__nv"), clicks.alias("__nc"))
    both = per_ad.where((F.col("__nv") > 0) & (F.col("__nc") > 0))
    # the pairs' event time is the last instant of their window
    last = F.window_time("window") if u.isStreaming or kind != "session" else \
        F.col("window.end") - F.expr("INTERVAL 1 MICROSECOND")
    weighted = both.select("ad_id", last.alias("event_time"), (F.col("__nv") * F.col("__nc")).alias("__w"))
    return count_by_campaign(enrich(weighted, campaigns, unknown), kind, size_ms, weight="__w")


def count_joined_enriched(events: DataFrame, kind: str, size_ms: int, view: str = "view", click: str = "click") -> DataFrame:
    """:func:`count_joined_events` from events that carry a campaign of their own ``(ad_id, campaign_id, et,
    event_time)``: a pair has its view's, and an ad may have had more than one (tumbling and sliding windows)."""
    if kind == "session":
        raise ValueError("sessions of enriched events are joined, not counted")
    tagged = events.where(F.col("et").isin(view, click)).select(
        "ad_id", "event_time", F.when(F.col("et") == view, F.col("campaign_id")).alias("__of"))
    per_ad = tagged.groupBy("ad_id", window_column(kind, size_ms).alias("window"), "__of").agg(F.count(F.lit(1)).alias("__n"))
    seen = F.col("__of").isNotNull()   # an ad has a few campaigns at most: those it had while the window was open
    both = per_ad.groupBy("ad_id", "window").agg(
        F.sum(F.when(~seen, F.col("__n"))).alias("__clicks"),
        F.collect_list(F.when(seen, F.struct(F.col("__of").alias("campaign_id"), F.col("__n").alias("views")))).alias("__views"))
    weighted = both.where("__clicks > 0").select(F.window_time("window").alias("event_time"), "__clicks", F.explode("__views").alias("v"))
    return count_by_campaign(weighted.select("event_time", "v.campaign_id", (F.col("v.views") * F.col("__clicks")).alias("__w")),
                             kind, size_ms, weight="__w")


def count_joined_pairs(views: DataFrame, clicks: DataFrame, campaigns: DataFrame,
                       kind: str, size_ms: int, unknown: str = UNKNOWN) -> DataFrame:
    """The literal plan: enrich views, build every pair, count pairs (for checks)."""
    ev = enrich(views, campaigns, unknown)
    return count_by_campaign(window_join(ev, clicks, kind, size_ms), kind, size_ms)
