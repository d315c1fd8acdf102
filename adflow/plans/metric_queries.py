"""Registered metric and profile queries over the test tables, with DuckDB oracles.

Samples fixture (adflow.sources.testdata.samples): metric = event type, labels
pod / namespace / job / operator_name.  Per-event samples have one second per
event; bucketed samples put 50 consecutive events into one second, so that every
second holds all metrics and several label sets of a pod; the unique ones keep
one sample per (metric, label set, second), as a metric source does.

Fixed role mapping of the test metrics:
    view     cpu, watermark (source op-0, sink op-1), pinned state (op-2), latency
    click    memory, throughput
    purchase state usage (op-2), consumer lag, uptime (seconds; ms = value * 1000)
    signup   state capacity, restarts, checkpoint duration
    error    workers, back-pressure (back-pressured when value > 100)
"""

from __future__ import annotations

from pyspark.sql import functions as F

from adflow.operators import metrics as M
from adflow.operators.profiles import REAL_COLUMNS, ProfileTable, build_profiles, profiles_select
from adflow.plans.registry import query, sql_round
from adflow.session import scratch_dir
from adflow.sources import testdata as td

BASE = td.SERIES_BASE_S
BUCKET = 50
ROLES = {"latency": "view", "throughput": "click", "backpressure": "error",
         "consumer_lag": "purchase", "checkpoint_duration": "signup",
         "cpu": "view", "memory": "click"}
BACKPRESSURE_ABOVE = 100.0
EXP_SECONDS = 20  # bucketed seconds per experiment (= 1000 events)
SINGLE_SPAN = 40  # seconds of a range query's part in the single-series form

_LABELS = ("CASE WHEN user_id % 4 = 3 AND event_id % 2 <> 0 THEN 'pod-3,zone=z' ELSE 'pod-' || CAST(user_id % 4 AS VARCHAR) END AS pod, "
           "CASE WHEN user_id % 4 = 3 AND event_id % 2 = 0 THEN 'z' END AS zone, 'default' AS namespace, "
           "'job-' || CAST(user_id % 3 AS VARCHAR) AS job, 'op-' || CAST(event_id % 3 AS VARCHAR) AS operator_name")
_ENTRIES = [(n, f"{{'name': '{n}', 'value': {n}}}") for n in ("job", "namespace", "operator_name", "pod")]
#: a label set: its entries in order of the names
_TEXT = ("list_filter([" + ", ".join(e for _, e in _ENTRIES) + ", {'name': 'zone', 'value': zone}], lambda x: x.value IS NOT NULL) AS lt")
PS = f"(SELECT *, {_TEXT} FROM (SELECT event_type AS metric, {_LABELS}, {BASE} + event_id AS ts, value FROM events) p0)"
BS = f"(SELECT *, {_TEXT} FROM (SELECT event_type AS metric, {_LABELS}, {BASE} + event_id // {BUCKET} AS ts, value FROM events) b0)"
US = f"(SELECT metric, pod, zone, namespace, job, operator_name, lt, ts, max(value) AS value FROM {BS} u0 GROUP BY ALL)"


def _on_grid_sql(src: str, per_ts_sql: str, digits: int = 6) -> str:
    """``per_ts_sql`` gives (ts, v); lay it on the grid of all samples in ``src``."""
    return f"""
WITH r AS (SELECT min(ts) AS lo, max(ts) AS hi FROM {src} s0),
g AS (SELECT unnest(range(lo, hi + 1)) AS ts FROM r),
a AS ({per_ts_sql})
SELECT g.ts, {sql_round('a.v', digits)} AS value FROM g LEFT JOIN a ON g.ts = a.ts"""


def ps(spark, sf):
    return td.samples(spark, sf)


def bs(spark, sf):
    return td.samples(spark, sf, bucket=BUCKET)


def us(spark, sf):
    return bs(spark, sf).groupBy("metric", "labels", "ts").agg(F.max("value").alias("value"))


def _r(df, digits=6):
    return df.select("ts", F.round("value", digits).alias("value"))


# --- matrix documents ---------------------------------------------------------------

@query("matrix_explode", f"""
SELECT metric, '{{"job":"' || job || '","namespace":"' || namespace || '","operator_name":"' || operator_name || '","pod":"' || pod
       || CASE WHEN zone IS NULL THEN '' ELSE '","zone":"' || zone END || '"}}' AS labels, ts, value FROM {US} s""")
def q_matrix_explode(spark, sf):
    return M.explode_matrix(td.matrix_docs(us(spark, sf))).select("metric", M.label_text().alias("labels"), "ts", "value")


@query("metric_by_label", f"""
WITH s AS {US}, r AS (SELECT min(ts) AS lo, max(ts) AS hi FROM s),
v AS (SELECT pod, ts, arg_max(value, lt) AS value FROM s WHERE metric = 'view' GROUP BY pod, ts),
p AS (SELECT DISTINCT pod FROM v),
g AS (SELECT p.pod, unnest(range(r.lo, r.hi + 1)) AS ts FROM p, r)
SELECT g.pod, g.ts, v.value FROM g LEFT JOIN v ON v.pod = g.pod AND v.ts = g.ts""")
def q_metric_by_label(spark, sf):
    """Documents in the order of their label sets: of the series of a pod, the last one gives a second its value."""
    samples = M.explode_matrix(td.matrix_docs(us(spark, sf))).drop("at")
    return M.series_by_label(samples, "pod", metric="view")


@query("metric_single_series", f"""
WITH s AS {US}, r AS (SELECT min(ts) AS lo, max(ts) AS hi FROM s),
q AS (SELECT lt, ts, value, (ts - lo) // {SINGLE_SPAN} AS part, ts - lo AS off FROM s, r WHERE metric = 'view'),
p AS (SELECT lt, ts, value, part FROM q UNION ALL SELECT lt, ts, value, part - 1 FROM q WHERE off > 0 AND off % {SINGLE_SPAN} = 0),
f AS (SELECT part, min(lt) AS lt FROM p GROUP BY part),
v AS (SELECT ts, value FROM (SELECT p.ts, p.value, row_number() OVER (PARTITION BY p.ts ORDER BY p.part DESC) AS rn
      FROM p JOIN f ON p.part = f.part AND p.lt = f.lt) x WHERE rn = 1),
g AS (SELECT unnest(range(lo, hi + 1)) AS ts FROM r)
SELECT g.ts, v.value FROM g LEFT JOIN v ON g.ts = v.ts""")
def q_single_series(spark, sf):
    df = us(spark, sf)
    return M.first_series(M.where_labels(df, "view"), bounds=M.job_bounds(df), span=SINGLE_SPAN)


@query("metric_job_bounds", """
SELECT 'job-' || CAST(user_id % 3 AS VARCHAR) AS job_id, CAST(ceil(min(epoch_ms(ts)) / 1000.0) AS BIGINT) AS "start",
       CAST(ceil(max(epoch_ms(ts)) / 1000.0) AS BIGINT) AS "end" FROM events GROUP BY 1""")
def q_job_bounds(spark, sf):
    """The first and last event of a job, in milliseconds, as bounds in seconds."""
    ev = td.table(spark, sf, "events")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    job = F.concat(F.lit("job-"), F.pmod(F.col("user_id"), F.lit(3)).cast("string"))
    return ev.groupBy(job.alias("job_id")).agg(M.seconds_up(F.min(ms)).alias("start"), M.seconds_up(F.max(ms)).alias("end"))


@query("metric_series_keys", f"SELECT DISTINCT pod FROM {PS} s")
def q_series_keys(spark, sf):
    return M.series_keys(ps(spark, sf), "pod")


# --- expressions per timestamp ----------------------------------------------------------

@query("metric_filter_sum", _on_grid_sql(BS, f"""
SELECT ts, sum(value) AS v FROM {BS} s WHERE metric = 'view' AND regexp_full_match(pod, 'pod-[01]')
GROUP BY ts"""))
def q_filter_sum(spark, sf):
    df = bs(spark, sf)
    return _r(M.metric_sum(df, "view", regex={"pod": "pod-[01]"}, bounds=M.job_bounds(df)))


@query("metric_mean", _on_grid_sql(BS, f"""
SELECT ts, sum(value) / count(value) AS v FROM {BS} s WHERE metric = 'purchase' AND namespace = 'default'
GROUP BY ts"""))
def q_mean(spark, sf):
    df = bs(spark, sf)
    return _r(M.metric_mean(df, "purchase", eq={"namespace": "default"}, bounds=M.job_bounds(df)))


TOTAL_SQL = _on_grid_sql(BS, f"SELECT ts, sum(value) AS v FROM {BS} s WHERE metric = 'click' GROUP BY ts")


@query("metric_total_by_ts", TOTAL_SQL)
def q_total(spark, sf):
    df = bs(spark, sf)
    return _r(M.total_by_ts(df, "click", bounds=M.job_bounds(df)))


@query("metric_max_over_time", f"""
WITH s AS (SELECT * FROM {PS} s0 WHERE metric = 'signup'),
r AS (SELECT min(ts) AS lo, max(ts) AS hi FROM {PS} s1),
p AS (SELECT DISTINCT lt FROM s),
g AS (SELECT p.lt, unnest(range(r.lo, r.hi + 1)) AS ts FROM p, r),
m AS (SELECT lt, ts, max(value) AS v FROM s GROUP BY 1, 2),
d AS (SELECT g.lt, g.ts, m.v FROM g LEFT JOIN m ON g.lt = m.lt AND g.ts = m.ts),
w AS (SELECT ts, max(v) OVER (PARTITION BY lt ORDER BY ts RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) AS mx FROM d)
SELECT ts, {sql_round('sum(mx)', 6)} AS value FROM w GROUP BY ts""")
def q_max_over_time(spark, sf):
    return _r(M.trailing_max_sum(ps(spark, sf), "signup", seconds=3600))


_SOURCE, _SINK = "metric = 'view' AND operator_name = 'op-0'", "metric = 'view' AND operator_name = 'op-1'"
_DELAY = (f"abs((sum(CASE WHEN {_SOURCE} AND value > 0 THEN value END) - sum(CASE WHEN {_SINK} AND value > 0 THEN value END))"
          " / avg(CASE WHEN metric = 'error' THEN value END) / 1000.0)")
_SUMS = ("(sum(CASE WHEN metric = 'purchase' AND operator_name = 'op-2' THEN value END)"
         " + sum(CASE WHEN metric = 'view' AND operator_name = 'op-2' THEN value END))")
_CAPACITY = "max(CASE WHEN metric = 'signup' THEN value END)"
_USAGE = f"{_SUMS} / ({_CAPACITY} * avg(CASE WHEN metric = 'error' THEN value END))"


def terms():
    """The samples that play each role (predicates need a running session)."""
    op = lambda metric, name: M.selects(metric, {"operator_name": name})
    return {"source": op("view", "op-0"), "sink": op("view", "op-1"), "usage": op("purchase", "op-2"), "pinned": op("view", "op-2"),
            "capacity": "signup", "workers": "error", "cpu": "view", "memory": "click", "restarts": "signup"}


@query("metric_delay", _on_grid_sql(BS, f"""
SELECT ts, CASE WHEN d < 1500 THEN d END AS v FROM (SELECT ts, {_DELAY} AS d FROM {BS} s GROUP BY ts) x""", digits=9))
def q_delay(spark, sf):
    df, t = bs(spark, sf), terms()
    return _r(M.progress_delay(df, t["source"], t["sink"], t["workers"], bounds=M.job_bounds(df)), 9)


@query("metric_state_usage", _on_grid_sql(BS, f"SELECT ts, {_USAGE} AS v FROM {BS} s GROUP BY ts", digits=9))
def q_state_usage(spark, sf):
    df, t = bs(spark, sf), terms()
    return _r(M.state_usage(df, t["usage"], t["pinned"], t["capacity"], t["workers"], bounds=M.job_bounds(df)), 9)


@query("metric_state_usage_by_pod", f"""
SELECT namespace, pod, ts, {sql_round(f"{_SUMS} / {_CAPACITY}", 9)} AS value FROM {BS} s GROUP BY namespace, pod, ts""")
def q_state_usage_by_pod(spark, sf):
    t = terms()
    out = M.state_usage(bs(spark, sf), t["usage"], t["pinned"], t["capacity"], None, by=("namespace", "pod"))
    return out.select("namespace", "pod", "ts", F.round("value", 9).alias("value"))


@query("metric_uptime", f"""
WITH s AS {US}, r AS (SELECT max(ts) AS hi FROM s)
SELECT pod, coalesce(CAST(trunc(CASE WHEN ts = hi THEN value * 1000 END) AS BIGINT) // 1000, 0) AS uptime_s FROM (
  SELECT pod, ts, value, hi, row_number() OVER (PARTITION BY pod ORDER BY lt, ts DESC) AS rn
  FROM s, r WHERE metric = 'purchase') x WHERE rn = 1""")
def q_uptime(spark, sf):
    df = us(spark, sf)
    up = M.where_labels(df, "purchase").select(F.col("labels")["pod"].alias("pod"), "labels", "ts", (F.col("value") * 1000).alias("value"))
    return M.uptime_seconds(up, by=["pod"], bounds=M.job_bounds(df))


_EXPORTED = {"cpuLoad": "a.cpu", "memUsed": "a.memory", "numWorkers": "a.workers", "numRestarts": "r.v",
             "delay": "CASE WHEN a.delay < 1500 THEN a.delay END", "stateUsage": "a.usage"}


@query("metric_export", f"""
WITH s AS {BS},
b AS (SELECT job, min(ts) AS lo, max(ts) AS hi FROM s GROUP BY job),
g AS (SELECT job, unnest(range(lo, hi + 1)) AS ts FROM b),
a AS (SELECT job, ts, sum(CASE WHEN metric = 'view' THEN value END) AS cpu, sum(CASE WHEN metric = 'click' THEN value END) AS memory,
             sum(CASE WHEN metric = 'error' THEN value END) AS workers, {_DELAY} AS delay, {_USAGE} AS usage
      FROM s GROUP BY job, ts),
m AS (SELECT job, lt, ts, max(value) AS v FROM s WHERE metric = 'signup' GROUP BY ALL),
p AS (SELECT DISTINCT job, lt FROM m),
d AS (SELECT p.job, p.lt, g.ts, m.v FROM p JOIN g ON p.job = g.job LEFT JOIN m ON m.job = p.job AND m.lt = p.lt AND m.ts = g.ts),
w AS (SELECT job, ts, max(v) OVER (PARTITION BY job, lt ORDER BY ts RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) AS mx FROM d),
r AS (SELECT job, ts, sum(mx) AS v FROM w GROUP BY 1, 2)
""" + "\nUNION ALL\n".join(f"""SELECT g.job AS job_id, '{n}' AS name, g.ts, {sql_round(f"({v})", 9)} AS value
FROM g LEFT JOIN a ON a.job = g.job AND a.ts = g.ts LEFT JOIN r ON r.job = g.job AND r.ts = g.ts""" for n, v in _EXPORTED.items()))
def q_export(spark, sf):
    path = scratch_dir(spark, "metrics")
    M.export_metrics(M.export_series(bs(spark, sf), "job", terms(), scratch_dir(spark, "partials")), path)
    return M.read_exported(spark, path).select("job_id", "name", "ts", F.round("value", 9).alias("value"))


# --- profiles -----------------------------------------------------------------------------

def _role(role: str) -> str:
    return f"CASE WHEN metric = '{ROLES[role]}' THEN value END"


_BP_SHARE = (f"(CAST(count(CASE WHEN {_role('backpressure')} > {BACKPRESSURE_ABOVE} THEN 1 END) "
             f"AS DOUBLE) / nullif(count({_role('backpressure')}), 0))")


def _agg(agg: str, role: str) -> str:
    return sql_round(f"{agg}({_role(role)})", 8)


PROFILE_SQL = f"""
SELECT CAST((ts - {BASE}) // {EXP_SECONDS} AS INTEGER) AS expId,
       CAST(count(DISTINCT pod) AS INTEGER) AS scaleOut,
       job AS jobId,
       CAST(floor(round(sum({_role('throughput')}), 6)) AS BIGINT) AS workload,
       {_agg('avg', 'latency')} AS avgLat,
       {_agg('avg', 'throughput')} AS avgThr,
       CAST(max(CASE WHEN {_role('backpressure')} > {BACKPRESSURE_ABOVE} THEN 1 ELSE 0 END) AS INTEGER) AS isBckPres,
       {sql_round(_BP_SHARE, 8)} AS perBckPres,
       {_agg('avg', 'consumer_lag')} AS avgConsLag,
       {_agg('avg', 'checkpoint_duration')} AS avgChkDur,
       {_agg('avg', 'cpu')} AS cpuAvg,
       {_agg('avg', 'memory')} AS memAvg,
       {_agg('sum', 'cpu')} AS cpuTotal,
       {_agg('sum', 'memory')} AS memTotal,
       min(ts) AS startTs, max(ts) AS stopTs
FROM {BS} s GROUP BY 1, 3"""


def built_profiles(spark, sf):
    df = bs(spark, sf)
    exp_id = F.floor((F.col("ts") - F.lit(BASE)) / F.lit(EXP_SECONDS)).cast("int")
    return build_profiles(df, exp_id, F.col("labels")["job"], ROLES, BACKPRESSURE_ABOVE)


def _rounded(df):
    return df.withColumns({c: F.round(c, 8) for c in REAL_COLUMNS})


def stored(spark, sf):
    """A table of its own, with the profiles inserted, opened again."""
    root = scratch_dir(spark, "profiles")
    ProfileTable(spark, root).insert(built_profiles(spark, sf))
    return ProfileTable(spark, root)


@query("profile_build", PROFILE_SQL)
def q_profile_build(spark, sf):
    return _rounded(built_profiles(spark, sf))


@query("profile_insert", PROFILE_SQL)
def q_profile_insert(spark, sf):
    return _rounded(stored(spark, sf).read())


@query("profile_select", f"""
WITH p AS ({PROFILE_SQL})
SELECT * FROM p WHERE expId IN (SELECT expId FROM p WHERE expId % 2 = 1) ORDER BY scaleOut, workload""")
def q_profile_select(spark, sf):
    table = stored(spark, sf).read()
    return _rounded(profiles_select(table, table.where(F.col("expId") % 2 == 1).select("expId")))


@query("profile_delete", f"""
WITH p AS ({PROFILE_SQL})
SELECT * FROM p WHERE expId % 3 <> 0""")
def q_profile_delete(spark, sf):
    table = stored(spark, sf)
    table.delete(table.read().where(F.col("expId") % 3 == 0).select("expId"))
    return _rounded(table.read())


@query("profile_delete_row", f"""
WITH p AS ({PROFILE_SQL})
SELECT * FROM p WHERE NOT (expId % 2 = 0 AND jobId <> 'job-1') AND expId % 5 <> 0""")
def q_profile_delete_row(spark, sf):
    table = stored(spark, sf)
    gone = ((F.col("expId") % 2 == 0) & (F.col("jobId") != "job-1")) | (F.col("expId") % 5 == 0)
    table.delete_jobs(table.read().where(gone))
    return _rounded(table.read())
