"""Registered time-series queries over the test tables, each with its DuckDB oracle.

Series fixture: one series per event type, ``ts`` = 1704067200 + event_id
(seconds), see adflow.sources.testdata.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from adflow.operators import series as S
from adflow.plans.registry import query, sql_round
from adflow.session import scratch_dir
from adflow.sources import testdata as td
from adflow.sources.series_csv import (read_rate_curve, read_series_csv, read_series_csv_rows,
                                       write_rate_curve, write_series_csv)

RATE, LIMIT = 3, 1000
CHUNK_S = 1000  # seconds of series per values / JSON chunk

SER = ("(SELECT event_type AS series_id, 1704067200 + event_id AS ts, "
       "value FROM events)")
GRID_SQL = f"""
WITH s AS {SER}, b AS (SELECT series_id, min(ts) AS lo, max(ts) AS hi FROM s GROUP BY 1),
g AS (SELECT series_id, unnest(range(lo, hi + 1)) AS ts FROM b)
SELECT g.series_id, g.ts, s.value FROM g LEFT JOIN s ON g.series_id = s.series_id AND g.ts = s.ts"""


def _merge_sql(where: str) -> str:
    return f"""
WITH u AS (SELECT ts, value FROM {SER} s WHERE {where}),
b AS (SELECT min(ts) AS lo, max(ts) AS hi FROM u),
g AS (SELECT unnest(range(lo, hi + 1)) AS ts FROM b),
a AS (SELECT ts, sum(value) AS value FROM u GROUP BY ts)
SELECT g.ts, a.value FROM g LEFT JOIN a ON g.ts = a.ts"""


def series(spark, sf):
    return td.series(spark, sf)


def one(spark, sf, name):
    return series(spark, sf).where(F.col("series_id") == name).select("ts", "value")


@query("series_grid", GRID_SQL)
def q_grid(spark, sf):
    return S.densify(series(spark, sf))


@query("series_from_csv", GRID_SQL)
def q_from_csv(spark, sf):
    """Two appends: each series is read over all of its files, the later one last."""
    path = scratch_dir(spark, "series-csv")
    rows = series(spark, sf)
    mid = rows.agg(F.floor((F.min("ts") + F.max("ts")) / 2)).scalar()
    write_series_csv(rows.where(F.col("ts") < mid), path, by=["series_id"])
    write_series_csv(rows.where(F.col("ts") >= mid), path, by=["series_id"])
    return read_series_csv(spark, path, by=["series_id"])


@query("series_csv_roundtrip", f"SELECT series_id, ts, value FROM {SER} s")
def q_csv_roundtrip(spark, sf):
    path = scratch_dir(spark, "series-csv")
    write_series_csv(series(spark, sf), path, by=["series_id"])
    return read_series_csv_rows(spark, path, by=["series_id"])


@query("rate_curve_csv", """
SELECT row_number() OVER (ORDER BY ts) - 1 AS i, ts, n AS value FROM (
  SELECT epoch_ms(date_trunc('hour', ts)) AS ts, CAST(count(*) AS INTEGER) AS n FROM events GROUP BY 1) h""")
def q_rate_curve(spark, sf):
    """The events per hour, written as a rate curve and read back in file order."""
    hour = F.unix_millis(F.date_trunc("hour", F.col("ts").cast("timestamp")))
    curve = td.table(spark, sf, "events").groupBy(hour.alias("ts")).agg(F.count(F.lit(1)).cast("int").alias("value"))
    path = scratch_dir(spark, "rate-curve")
    write_rate_curve(curve.withColumn("i", F.col("ts")), path)
    return read_rate_curve(spark, path)


@query("series_merge", _merge_sql("series_id IN ('view', 'click')"))
def q_merge(spark, sf):
    return S.merge(one(spark, sf, "view"), one(spark, sf, "click"))


@query("series_merge_many", _merge_sql("true"))
def q_merge_many(spark, sf):
    return S.merge(series(spark, sf))


@query("series_merge_aligned", _merge_sql("series_id IN ('view', 'click')"))
def q_merge_aligned(spark, sf):
    v, c = one(spark, sf, "view"), one(spark, sf, "click")
    bounds = S._global_bounds(v.unionByName(c))
    return S.merge_aligned(S.densify(v, by=(), bounds=bounds), S.densify(c, by=(), bounds=bounds))


@query("series_resample", f"""
WITH g AS ({GRID_SQL}), a AS (SELECT series_id, max(ts) AS anc FROM g GROUP BY 1)
SELECT g.series_id, g.ts, g.value FROM g JOIN a ON g.series_id = a.series_id
WHERE (anc - ts) % {RATE} = 0 AND (anc - ts) // {RATE} < {LIMIT}""")
def q_resample(spark, sf):
    return S.resample(S.densify(series(spark, sf), keep_bounds=True), RATE, limit=LIMIT)


@query("series_resample_irregular", f"""
SELECT series_id, ts, value FROM (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) - 1 AS pos FROM {SER} s) r
WHERE pos % {RATE} = 0 AND pos // {RATE} < {LIMIT}""")
def q_resample_irregular(spark, sf):
    return S.resample_irregular(series(spark, sf), RATE, limit=LIMIT, block=2048)


@query("series_first_last", f"""
WITH s AS {SER}, b AS (SELECT series_id, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY 1)
SELECT b.series_id, b.first_ts, f.value AS first_value, b.last_ts, l.value AS last_value
FROM b JOIN s f ON f.series_id = b.series_id AND f.ts = b.first_ts
       JOIN s l ON l.series_id = b.series_id AND l.ts = b.last_ts""")
def q_first_last(spark, sf):
    return S.first_last(series(spark, sf))


@query("series_lookup", f"""
SELECT k.ts, v.value FROM (SELECT ts FROM {SER} s0) k
LEFT JOIN (SELECT ts, value FROM {SER} s1 WHERE series_id = 'view') v ON k.ts = v.ts""")
def q_lookup(spark, sf):
    keys = series(spark, sf).select("ts")
    return S.lookup(one(spark, sf, "view"), keys)


@query("series_upsert", f"""
WITH v AS (SELECT ts, value FROM {SER} s WHERE series_id = 'view'),
c AS (SELECT ts, value FROM {SER} s WHERE series_id = 'click'),
b AS (SELECT min(ts) AS lo, max(ts) AS hi FROM v),
g AS (SELECT unnest(range(lo, hi + 1)) AS ts FROM b)
SELECT g.ts, CASE WHEN c.ts IS NOT NULL THEN c.value ELSE v.value END AS value
FROM g LEFT JOIN v ON g.ts = v.ts LEFT JOIN c ON g.ts = c.ts""")
def q_upsert(spark, sf):
    base = S.densify(one(spark, sf, "view"), by=())
    updates = one(spark, sf, "click").join(base.select("ts"), on="ts", how="left_semi")
    return S.upsert(base, updates)


_CHUNKS = f"""
WITH c AS (SELECT series_id, (ts // {CHUNK_S}) * {CHUNK_S} AS chunk_start, list({{'ts': ts, 'value': value}} ORDER BY ts) AS obs
           FROM {SER} s GROUP BY 1, 2),
n AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY chunk_start) - 1 AS chunk, chunk_start, obs,
             CAST(sum(len(obs)) OVER (PARTITION BY series_id) AS BIGINT) AS series_count,
             max(chunk_start) OVER (PARTITION BY series_id) = chunk_start AS last FROM c)"""


@query("series_values", f"""{_CHUNKS}
SELECT series_id, chunk, chunk_start, series_count,
       array_to_string(list_transform(obs, lambda o: CAST(o.value AS VARCHAR)), ',') AS values_text FROM n""")
def q_values(spark, sf):
    v = S.values(series(spark, sf), chunk_span=CHUNK_S)
    return v.select("series_id", "chunk", "chunk_start", "series_count", F.array_join(
        F.transform("values", lambda x: x.cast("string")), ",").alias("values_text"))


@query("series_to_json", f"""{_CHUNKS}
SELECT series_id, chunk, chunk_start, series_count,
       CASE WHEN chunk = 0 THEN '{{"observations":[' ELSE ', ' END
       || array_to_string(list_transform(obs, lambda o: '{{"timestamp":' || CAST(o.ts AS VARCHAR) || ',"value":'
                                         || coalesce(CAST(o.value AS VARCHAR), 'null') || '}}'), ', ')
       || CASE WHEN last THEN '],"count":' || CAST(series_count AS VARCHAR) || '}}' ELSE '' END AS json FROM n""")
def q_to_json(spark, sf):
    return S.to_json_text(series(spark, sf), chunk_span=CHUNK_S)


@query("series_json_documents", f"""
WITH s AS {SER}, n AS (SELECT series_id, count(*) AS "count" FROM s GROUP BY 1)
SELECT s.series_id, s.ts, s.value, n."count" FROM s JOIN n ON s.series_id = n.series_id""")
def q_json_documents(spark, sf):
    """One document per series, written and read again."""
    path = scratch_dir(spark, "series-json")
    S.write_series_json(series(spark, sf), path, chunk_span=CHUNK_S)
    back = S.read_series_json(spark, path)
    told = back.groupBy("series_id").agg(F.max("count").alias("count"))
    return back.drop("count").join(told, "series_id")


def _stats_sql(strict: bool) -> str:
    mn = "min(value)" if strict else "least(0.0, coalesce(min(value), 0.0))"
    mx = "max(value)" if strict else "greatest(0.0, coalesce(max(value), 0.0))"
    return f"""
SELECT series_id, {sql_round("coalesce(avg(value), 'NaN'::DOUBLE)", 6)} AS avg, {mn} AS min, {mx} AS max,
       {sql_round("coalesce(sum(value), 0.0)", 6)} AS sum, count(*) AS size
FROM ({GRID_SQL}) g GROUP BY series_id"""


def _rounded_stats(df):
    return df.select("series_id", F.round("avg", 6).alias("avg"), "min", "max",
                     F.round("sum", 6).alias("sum"), "size")


@query("series_stats", _stats_sql(strict=False))
def q_stats(spark, sf):
    return _rounded_stats(S.stats(S.densify(series(spark, sf))))


@query("series_stats_true", _stats_sql(strict=True))
def q_stats_true(spark, sf):
    return _rounded_stats(S.stats(S.densify(series(spark, sf)), strict=True))


@query("series_sorted", f"SELECT series_id, ts, value FROM {SER} s ORDER BY series_id, ts")
def q_sorted(spark, sf):
    return S.sorted_series(series(spark, sf))
