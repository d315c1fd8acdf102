"""Registered ad-job queries over the test tables, each with its DuckDB oracle.

Windows used on the test data (30 days of sparse events): tumbling 1 day,
sliding 5 days / 1 day, session gap 2 hours.  Times are epoch milliseconds.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from adflow.functions.messages import aggregate_message, event_message, join_message
from adflow.operators.counts import count_joined_events, count_views
from adflow.operators.enrich import enrich
from adflow.operators.joins import window_join
from adflow.operators.windows import end_ms
from adflow.plans.registry import query
from adflow.sources import testdata as td
from adflow.sources.campaigns import campaign_set, campaigns_for
from adflow.operators import workload as W
from adflow.operators.audit import late_audit
from adflow.session import scratch_dir
from adflow.sources.events import decode, encode, of_type, project, quarantined
from adflow.streaming.store import read_latest, upsert_counts

DAY_MS = 86_400_000
TUMBLE_MS = DAY_MS
SLIDE_SIZE_MS = 5 * DAY_MS  # slide = size / 5 = 1 day
SESSION_GAP_MS = 2 * 3_600_000

# --- DuckDB building blocks (same mapping as adflow.sources.testdata) --------
AE = ("(SELECT CASE WHEN user_id % 7 = 3 THEN 'x' ELSE '' END || CAST(user_id AS VARCHAR) AS ad_id, epoch_ms(date_trunc('second', ts)) AS t, "
      "event_type AS et FROM events)")
CAMP = ("(SELECT CAST(c_custkey AS VARCHAR) AS ad_id, "
        "'c' || CAST(c_custkey // 10 AS VARCHAR) AS campaign_id FROM customer)")
VIEWS_ENRICHED = (f"(SELECT coalesce(c.campaign_id, 'UNKNOWN') AS campaign_id, e.ad_id, e.t "
                  f"FROM {AE} e LEFT JOIN {CAMP} c ON e.ad_id = c.ad_id WHERE e.et = 'view')")
CLICKS = f"(SELECT ad_id, t FROM {AE} WHERE et = 'click')"


def _sliding_end(t: str, size: int = SLIDE_SIZE_MS) -> str:
    d = size // 5
    return f"(({t}) // {d} - r.i) * {d} + {size}"


def _session_sql(rows: str, key: str, t: str, gap: int, extra: str = "") -> str:
    """Rows of ``rows`` with a session id ``sid`` per ``key`` (touching events merge)."""
    return f"""(SELECT *, sum(nw) OVER (PARTITION BY {key} ORDER BY {t} RANGE UNBOUNDED PRECEDING) AS sid
  FROM (SELECT *, CASE WHEN {t} - lag({t}) OVER (PARTITION BY {key} ORDER BY {t}) <= {gap}
                   THEN 0 ELSE 1 END AS nw FROM {rows} {extra}) s0)"""


def ad_events(spark, sf):
    return td.ad_events(spark, sf)


def views(spark, sf):
    return project(of_type(td.ad_events(spark, sf), "view"))


def clicks(spark, sf):
    return project(of_type(td.ad_events(spark, sf), "click"))


def enriched_views(spark, sf):
    return enrich(views(spark, sf), td.campaigns(spark, sf))


# --- decode / encode / filter / project / enrich ------------------------------

@query("decode_ad_events", f"SELECT ad_id, t AS ts, et FROM {AE} WHERE et <> 'error'")
def q_decode(spark, sf):
    return decode(td.wire_events(spark, sf), mode="permissive").select("ad_id", "ts", "et")


@query("decode_quarantine", """
SELECT CAST(user_id AS VARCHAR) AS key,
       CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN '{"ts":1700000000000,"id":"a","et":"view"}'
            WHEN 2 THEN '{"ts":" 1700000000000","id":"a","et":"view"}' ELSE '{"ts":"1700000000000","id":7,"et":"view"}' END AS value,
       CAST(user_id % 4 AS INTEGER) AS "partition",
       event_id AS "offset" FROM events WHERE event_type = 'error'""")
def q_quarantine(spark, sf):
    return quarantined(td.wire_events(spark, sf)).select("key", "value", "partition", "offset")


@query("encode_ad_events", f"""
SELECT ad_id AS key, '{{"ts":"' || CAST(t AS VARCHAR) || '","id":"' || ad_id || '","et":"' || et || '"}}' AS value,
       t AS ts FROM {AE}""")
def q_encode(spark, sf):
    return encode(td.ad_events(spark, sf)).select(
        "key", "value", F.unix_millis("timestamp").alias("ts"))


@query("message_event", f"SELECT '{{ts:' || CAST(t AS VARCHAR) || ', id:' || ad_id || ', et:' || et || '}}' AS value FROM {AE}")
def q_message_event(spark, sf):
    return event_message(td.ad_events(spark, sf))


@query("filter_view", f"SELECT ad_id, t AS ts, et FROM {AE} WHERE et = 'view'")
def q_filter_view(spark, sf):
    return of_type(td.ad_events(spark, sf), "view").select("ad_id", "ts", "et")


@query("filter_click", f"SELECT ad_id, t AS ts, et FROM {AE} WHERE et = 'click'")
def q_filter_click(spark, sf):
    return of_type(td.ad_events(spark, sf), "click").select("ad_id", "ts", "et")


@query("project_event", f"SELECT ad_id, t AS ts FROM {AE} WHERE et = 'view'")
def q_project(spark, sf):
    return views(spark, sf).select("ad_id", "ts")


@query("enrich_campaign", f"SELECT campaign_id, ad_id, t AS ts FROM {VIEWS_ENRICHED}")
def q_enrich(spark, sf):
    return enriched_views(spark, sf).select("campaign_id", "ad_id", "ts")


# --- campaign table -----------------------------------------------------------

@query("campaign_dim", """
SELECT c_custkey AS ad_num, substr(sha256('adflow:ad:' || CAST(c_custkey AS VARCHAR)), 1, 16) AS ad_id,
       c_custkey // 10 AS campaign_num,
       substr(sha256('adflow:campaign:' || CAST(c_custkey // 10 AS VARCHAR)), 1, 16) AS campaign_id
FROM customer""")
def q_campaign_dim(spark, sf):
    return campaigns_for(td.table(spark, sf, "customer").select(F.col("c_custkey").alias("ad_num")))


@query("campaign_set", """
SELECT DISTINCT substr(sha256('adflow:campaign:' || CAST(c_custkey // 10 AS VARCHAR)), 1, 16) AS campaign_id
FROM customer""")
def q_campaign_set(spark, sf):
    dim = campaigns_for(td.table(spark, sf, "customer").select(F.col("c_custkey").alias("ad_num")))
    return campaign_set(dim)


# --- view counts ---------------------------------------------------------------

@query("view_count_tumbling", f"""
SELECT campaign_id, count(*) AS "count", (t // {TUMBLE_MS} + 1) * {TUMBLE_MS} AS window_end
FROM {VIEWS_ENRICHED} v GROUP BY 1, 3""")
def q_view_count_tumbling(spark, sf):
    return count_views(views(spark, sf), td.campaigns(spark, sf), "tumbling", TUMBLE_MS)


@query("view_count_sliding", f"""
SELECT campaign_id, count(*) AS "count", {_sliding_end('t')} AS window_end
FROM {VIEWS_ENRICHED} v, range(5) r(i) GROUP BY 1, 3""")
def q_view_count_sliding(spark, sf):
    return count_views(views(spark, sf), td.campaigns(spark, sf), "sliding", SLIDE_SIZE_MS)


@query("view_count_session", f"""
SELECT campaign_id, count(*) AS "count", max(t) + {SESSION_GAP_MS} AS window_end
FROM {_session_sql(VIEWS_ENRICHED, 'campaign_id', 't', SESSION_GAP_MS)} s GROUP BY campaign_id, sid""")
def q_view_count_session(spark, sf):
    return count_views(views(spark, sf), td.campaigns(spark, sf), "session", SESSION_GAP_MS)


# --- view x click joins -----------------------------------------------------------

JOIN_TUMBLING_SQL = f"""
SELECT v.campaign_id, v.ad_id, k.t AS ts_clicked, (v.t // {TUMBLE_MS} + 1) * {TUMBLE_MS} AS window_end
FROM {VIEWS_ENRICHED} v JOIN {CLICKS} k ON v.ad_id = k.ad_id AND v.t // {TUMBLE_MS} = k.t // {TUMBLE_MS}"""

JOIN_SLIDING_SQL = f"""
SELECT v.campaign_id, v.ad_id, k.ts_clicked, v.we AS window_end
FROM (SELECT campaign_id, ad_id, {_sliding_end('t')} AS we FROM {VIEWS_ENRICHED} v, range(5) r(i)) v
JOIN (SELECT ad_id, t AS ts_clicked, {_sliding_end('t')} AS we FROM {CLICKS} k, range(5) r(i)) k
  ON v.ad_id = k.ad_id AND v.we = k.we"""

_SESSION_EVENTS = (f"(SELECT e.ad_id, e.t, e.et, coalesce(c.campaign_id, 'UNKNOWN') AS campaign_id "
                   f"FROM {AE} e LEFT JOIN {CAMP} c ON e.ad_id = c.ad_id WHERE e.et IN ('view', 'click'))")
JOIN_SESSION_SQL = f"""
WITH s AS {_session_sql(_SESSION_EVENTS, 'ad_id', 't', SESSION_GAP_MS)},
b AS (SELECT ad_id, sid, max(t) + {SESSION_GAP_MS} AS window_end FROM s GROUP BY ad_id, sid)
SELECT v.campaign_id, v.ad_id, k.t AS ts_clicked, b.window_end
FROM s v JOIN s k ON v.ad_id = k.ad_id AND v.sid = k.sid AND v.et = 'view' AND k.et = 'click'
JOIN b ON b.ad_id = v.ad_id AND b.sid = v.sid"""


def _join_out(df):
    return df.select("campaign_id", "ad_id", "ts_clicked", end_ms("window").alias("window_end"))


def joined(spark, sf, kind, size):
    return window_join(enriched_views(spark, sf), clicks(spark, sf), kind, size)


@query("join_tumbling", JOIN_TUMBLING_SQL)
def q_join_tumbling(spark, sf):
    return _join_out(joined(spark, sf, "tumbling", TUMBLE_MS))


@query("join_sliding", JOIN_SLIDING_SQL)
def q_join_sliding(spark, sf):
    return _join_out(joined(spark, sf, "sliding", SLIDE_SIZE_MS))


@query("join_session", JOIN_SESSION_SQL)
def q_join_session(spark, sf):
    return _join_out(joined(spark, sf, "session", SESSION_GAP_MS))


@query("join_count_tumbling", f"""
SELECT campaign_id, count(*) AS "count", window_end FROM ({JOIN_TUMBLING_SQL}) p GROUP BY 1, 3""")
def q_join_count_tumbling(spark, sf):
    return count_joined_events(td.ad_events(spark, sf), td.campaigns(spark, sf), "tumbling", TUMBLE_MS)


@query("join_count_sliding", f"""
SELECT campaign_id, count(*) AS "count", {_sliding_end('window_end - 1')} AS window_end
FROM ({JOIN_SLIDING_SQL}) p, range(5) r(i) GROUP BY 1, 3""")
def q_join_count_sliding(spark, sf):
    return count_joined_events(td.ad_events(spark, sf), td.campaigns(spark, sf), "sliding", SLIDE_SIZE_MS)


@query("join_count_session", f"""
SELECT campaign_id, count(*) AS "count", max(t2) + {SESSION_GAP_MS} AS window_end
FROM {_session_sql(f'(SELECT campaign_id, window_end - 1 AS t2 FROM ({JOIN_SESSION_SQL}) p0)', 'campaign_id', 't2', SESSION_GAP_MS)} s
GROUP BY campaign_id, sid""")
def q_join_count_session(spark, sf):
    return count_joined_events(td.ad_events(spark, sf), td.campaigns(spark, sf), "session", SESSION_GAP_MS)


# --- messages -------------------------------------------------------------------

@query("message_join", f"""
SELECT '{{campaign_id: ' || campaign_id || ', ad_id: ' || ad_id || ', ts_clicked: ' || CAST(ts_clicked AS VARCHAR) || '}}' AS value
FROM ({JOIN_TUMBLING_SQL}) p""")
def q_message_join(spark, sf):
    return join_message(joined(spark, sf, "tumbling", TUMBLE_MS))


@query("message_aggregate", f"""
SELECT '{{campaign_id: ' || campaign_id || ', count: ' || CAST(count(*) AS VARCHAR) || ', window: '
       || CAST((t // {TUMBLE_MS} + 1) * {TUMBLE_MS} AS VARCHAR) || '}}' AS value
FROM {VIEWS_ENRICHED} v GROUP BY campaign_id, t // {TUMBLE_MS}""")
def q_message_aggregate(spark, sf):
    return aggregate_message(
        count_views(views(spark, sf), td.campaigns(spark, sf), "tumbling", TUMBLE_MS))


# --- late-row audit -----------------------------------------------------------------

AUDIT_WINDOW_MS = 3_600_000
AUDIT_DELAY_MS = 1_000
REVERSE_BLOCK = 16  # arrival order: each run of 16 consecutive events arrives reversed


@query("late_audit", f"""
WITH a AS (SELECT CAST(user_id % 4 AS INTEGER) AS "partition",
                  (event_id // {REVERSE_BLOCK}) * {REVERSE_BLOCK} + {REVERSE_BLOCK - 1} - event_id % {REVERSE_BLOCK} AS "offset",
                  CAST(user_id AS VARCHAR) AS ad_id, epoch_ms(date_trunc('second', ts)) AS ts FROM events),
b AS (SELECT *, max(ts) OVER (PARTITION BY "partition" ORDER BY "offset"
                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {AUDIT_DELAY_MS} AS watermark FROM a)
SELECT "partition", "offset", ad_id, ts, (ts // {AUDIT_WINDOW_MS} + 1) * {AUDIT_WINDOW_MS} AS window_end, watermark,
       coalesce((ts // {AUDIT_WINDOW_MS} + 1) * {AUDIT_WINDOW_MS} <= watermark, false) AS late
FROM b""")
def q_late_audit(spark, sf):
    ev = td.table(spark, sf, "events")
    eid = F.col("event_id")
    arrivals = ev.select(
        F.pmod(F.col("user_id"), F.lit(4)).cast("int").alias("partition"),
        (F.floor(eid / REVERSE_BLOCK) * REVERSE_BLOCK + (REVERSE_BLOCK - 1)
         - F.pmod(eid, F.lit(REVERSE_BLOCK))).cast("long").alias("offset"),
        F.col("user_id").cast("string").alias("ad_id"),
        F.unix_millis(F.date_trunc("second", F.col("ts").cast("timestamp"))).alias("ts"),
    )
    return late_audit(arrivals, AUDIT_DELAY_MS, "tumbling", AUDIT_WINDOW_MS, block=1024)


# --- workload generator ---------------------------------------------------------------

WORKLOAD_START_MS = 1_700_000_000_000
CURVE_INTERVAL_S = 3600  # the rate curve: events per hour of the events table

_CURVE_SQL = f"""
h AS (SELECT CAST(floor(epoch(ts) / {CURVE_INTERVAL_S}) AS BIGINT) AS hr, count(*) AS n FROM events GROUP BY 1),
r AS (SELECT min(hr) AS lo, max(hr) AS hi FROM h),
g AS (SELECT unnest(range(lo, hi + 1)) AS hr, lo FROM r),
curve AS (SELECT g.hr - g.lo AS i, coalesce(h.n, 0) AS value FROM g LEFT JOIN h ON g.hr = h.hr)"""


def _mix_sql(i: str, k: str, a: int, b: int, salt: int) -> str:
    return f"((({i}) % {W.HASH_MODULUS}) * {a} + ({k}) * {b} + {salt}) % {W.HASH_MODULUS}"


def workload_inputs(spark, sf):
    curve = W.events_per_interval(td.table(spark, sf, "events"), "ts", CURVE_INTERVAL_S)
    ads = campaigns_for(td.table(spark, sf, "customer").select(F.col("c_custkey").alias("ad_num")))
    return curve, ads


@query("workload_expand", f"""
WITH {_CURVE_SQL},
ev AS (SELECT i AS second, unnest(range(1, value + 1)) AS k FROM curve WHERE value > 0),
n AS (SELECT count(*) AS n FROM customer),
ads AS (SELECT c_custkey AS ad_num, substr(sha256('adflow:ad:' || CAST(c_custkey AS VARCHAR)), 1, 16) AS ad_id FROM customer)
SELECT e.second, e.k, {WORKLOAD_START_MS} + e.second * 1000 AS ts, ads.ad_id,
       ['view', 'click', 'purchase'][{_mix_sql('e.second', 'e.k', W.HASH_B, W.HASH_A, W.TYPE_SALT)} % 3 + 1] AS et
FROM ev e CROSS JOIN n JOIN ads ON ads.ad_num = {_mix_sql('e.second', 'e.k', W.HASH_A, W.HASH_B, W.AD_SALT)} % n.n""")
def q_workload_expand(spark, sf):
    curve, ads = workload_inputs(spark, sf)
    out = W.expand_workload(curve, ads, start_ms=WORKLOAD_START_MS)
    return out.select("second", F.col("k").cast("long").alias("k"), "ts", "ad_id", "et")


@query("workload_rate", f"""
WITH {_CURVE_SQL}
SELECT i AS second, CAST(value AS BIGINT) AS events FROM curve WHERE value > 0""")
def q_workload_rate(spark, sf):
    curve, ads = workload_inputs(spark, sf)
    gen = W.expand_workload(curve, ads, start_ms=WORKLOAD_START_MS)
    return W.events_per_second(gen)


# --- keyed latest-count store ----------------------------------------------------------

@query("campaign_window_store", f"""
SELECT campaign_id, count(*) AS "count", (t // {TUMBLE_MS} + 1) * {TUMBLE_MS} AS window_end
FROM {VIEWS_ENRICHED} v GROUP BY 1, 3""")
def q_campaign_window_store(spark, sf):
    """Two update batches: the counts of the first half of the time range, then
    the updated counts of every window the second half touches."""
    v = views(spark, sf)
    camps = td.campaigns(spark, sf)
    mid = v.agg(F.floor((F.min("ts") + F.max("ts")) / 2)).scalar()
    path = scratch_dir(spark, "campaign-store")
    first = v.where(F.col("ts") < mid)
    upsert_counts(count_views(first, camps, "tumbling", TUMBLE_MS), path, 0)
    touched = count_views(v.where(F.col("ts") >= mid), camps, "tumbling", TUMBLE_MS).select(
        "campaign_id", "window_end")
    updated = count_views(v, camps, "tumbling", TUMBLE_MS).join(
        touched, on=["campaign_id", "window_end"], how="left_semi")
    upsert_counts(updated, path, 1)
    return read_latest(spark, path).select("campaign_id", "count", "window_end")
