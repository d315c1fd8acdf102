"""The ad job as one DataFrame plan (batch or streaming input alike).

Modes (join, aggregate):
    (no,  yes)  views -> campaign lookup -> window count         -> aggregate message
    (yes, no)   views -> lookup, joined with clicks per ad/window -> join message
    (yes, yes)  the joined pairs counted per campaign and window  -> aggregate message
    (no,  no)   the enriched view stream; no sink is attached to it
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from adflow.config import PipelineConfig
from adflow.functions.messages import aggregate_message, join_message
from adflow.operators.counts import count_by_campaign, count_joined_enriched, count_joined_events, count_views
from adflow.operators.enrich import enrich
from adflow.operators.joins import window_join
from adflow.sources.events import of_type, project, with_event_time
from adflow.streaming.session_pairs import state_delay


def prepare(events: DataFrame, config: PipelineConfig) -> DataFrame:
    delay = config.watermark_delay_ms if events.isStreaming else None
    if delay is not None and config.window_kind == "session" and config.apply_join and not config.apply_aggregate:
        delay = state_delay(delay, config.window_size_ms)
    return with_event_time(events, delay_ms=delay)


def build(config: PipelineConfig, events: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Result rows of the configured mode (before message formatting)."""
    ev = prepare(events, config)
    views = project(of_type(ev, "view"))
    kind, size = config.window_kind, config.window_size_ms
    if config.apply_join:
        # the click side needs no campaign: the pair takes the view's campaign
        clicks = project(of_type(ev, "click"))
        if config.apply_aggregate:
            # one read of the source for both sides
            return count_joined_events(ev, campaigns, kind, size)
        return window_join(enrich(views, campaigns), clicks, kind, size)
    if config.apply_aggregate:
        return count_views(views, campaigns, kind, size)
    return enrich(views, campaigns)


def build_enriched(config: PipelineConfig, events: DataFrame) -> DataFrame:
    """:func:`build` over events that carry their campaign (``adflow.streaming.ingest``)."""
    ev = prepare(events, config)
    kind, size = config.window_kind, config.window_size_ms
    views = of_type(ev, "view").select("ad_id", "campaign_id", "ts", "event_time")
    if config.apply_join:
        if config.apply_aggregate:
            return count_joined_enriched(ev, kind, size)
        return window_join(views, project(of_type(ev, "click")), kind, size)
    return count_by_campaign(views, kind, size) if config.apply_aggregate else views


def has_sink(config: PipelineConfig) -> bool:
    return config.apply_join or config.apply_aggregate


def messages(config: PipelineConfig, events: DataFrame, campaigns: DataFrame) -> DataFrame:
    """The sink payload ``value`` of the configured mode."""
    return as_messages(config, build(config, events, campaigns))


def as_messages(config: PipelineConfig, rows: DataFrame) -> DataFrame:
    """Result rows of the configured mode -> the sink payload ``value``."""
    if not has_sink(config):
        raise ValueError("neither join nor aggregate is applied: the job has no sink")
    return aggregate_message(rows) if config.apply_aggregate else join_message(rows)
