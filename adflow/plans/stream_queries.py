"""Registered queries of the streaming operators over the test tables, with the DuckDB oracles of their batch forms.

A streamed query replays the events table in a few parts of ascending time,
then rows of two instants years later that close every window, and runs to the end of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adflow.operators.counts import count_joined_enriched
from adflow.operators.enrich import enrich
from adflow.operators.joins import hot_ads, window_join
from adflow.operators.windows import end_ms
from adflow.plans.ads_queries import (JOIN_SESSION_SQL, JOIN_SLIDING_SQL, JOIN_TUMBLING_SQL, SESSION_GAP_MS, SLIDE_SIZE_MS,
                                      TUMBLE_MS, _join_out, _sliding_end, clicks, enriched_views)
from adflow.plans.registry import query
from adflow.session import scratch_dir
from adflow.sources import testdata as td
from adflow.sources.campaigns import add_campaigns, current_campaigns
from adflow.sources.events import of_type, project
from adflow.streaming import ingest
from adflow.streaming.runner import use_rocksdb
from adflow.streaming.session_pairs import state_delay

FILES = 2                 # micro-batches of the replayed events
FLUSH = ("2090-01-01", "2095-01-01")
DELAY_MS = 1_000


def replayed(spark, events: DataFrame) -> DataFrame:
    """``events(ad_id, ts, et, event_time)`` as a stream, a part of their time a micro-batch, in order of time.

    A part lies in as many files as a micro-batch reads: each has a view of no ad
    beside its events, at the part's first instant, so that none is missing.
    """
    folder = scratch_dir(spark, "replay")
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    low, high = events.agg(F.min("ts"), F.max("ts")).first()
    width = (high - low) // FILES + 1 if low is not None else 1
    nothing = events.select("ad_id", "ts", "et").where(F.lit(False))
    parts = [(low + n * width, events.where(F.floor((F.col("ts") - low) / width) == n).select("ad_id", "ts", "et"))
             for n in range(FILES if low is not None else 0)]
    last = [(spark.sql(f"SELECT unix_millis(TIMESTAMP'{d}')").first()[0], nothing) for d in FLUSH]
    for begin, part in [*parts, *last]:
        own = spark.range(files).select(F.lit("flush").alias("ad_id"), F.lit(begin).cast("long").alias("ts"), F.lit("view").alias("et"),
                                        F.col("id").cast("int").alias("file"))
        dealt = part.withColumn("file", F.pmod(F.xxhash64("ad_id", "ts", "et"), F.lit(files)).cast("int"))
        dealt.unionByName(own).repartitionById(files, "file").drop("file").write.mode("append").parquet(folder)
    stream = spark.readStream.schema("ad_id string, ts long, et string").option("maxFilesPerTrigger", files).parquet(folder)
    return stream.withColumn("event_time", F.timestamp_millis("ts"))


def stream_session(spark: SparkSession) -> SparkSession:
    """A session of its own for a stream's settings: state in RocksDB, no more state partitions than cores."""
    own = spark.newSession()
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    cores = spark.sparkContext.defaultParallelism
    own.conf.set("spark.sql.shuffle.partitions", str(min(cores, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    use_rocksdb(own)
    return own


def run_stream(spark: SparkSession, out: DataFrame) -> DataFrame:
    """The rows that the stream ``out`` has written when it has come to its end."""
    path, checkpoint = scratch_dir(spark, "streamed"), scratch_dir(spark, "checkpoint")
    q = (out.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
         .foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(f"{path}/batch={n}")).start())
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(path).select(*out.columns)


@query("join_session_stream", JOIN_SESSION_SQL)
def q_join_session_stream(spark, sf):
    """Views joined with clicks per session of an ad, on a stream."""
    own = stream_session(spark)
    ev = replayed(own, td.ad_events(own, sf).where(F.col("et").isin("view", "click")))
    ev = ev.withWatermark("event_time", f"{state_delay(DELAY_MS, SESSION_GAP_MS)} milliseconds")
    views = enrich(project(of_type(ev, "view")), td.campaigns(own, sf))
    pairs = window_join(views, project(of_type(ev, "click")), "session", SESSION_GAP_MS)
    return run_stream(spark, pairs.select("campaign_id", "ad_id", "ts_clicked", end_ms("window").alias("window_end")))


def _dealt(spark, sf, kind, size):
    """The join with the ads above a thousandth of the events dealt out."""
    hot = hot_ads(td.ad_events(spark, sf), share=0.001)
    return _join_out(window_join(enriched_views(spark, sf), clicks(spark, sf), kind, size, hot=hot, cells=3))


@query("join_tumbling_dealt", JOIN_TUMBLING_SQL)
def q_join_tumbling_dealt(spark, sf):
    return _dealt(spark, sf, "tumbling", TUMBLE_MS)


@query("join_sliding_dealt", JOIN_SLIDING_SQL)
def q_join_sliding_dealt(spark, sf):
    return _dealt(spark, sf, "sliding", SLIDE_SIZE_MS)


@query("join_count_enriched", f"""
SELECT campaign_id, count(*) AS "count", {_sliding_end('window_end - 1')} AS window_end
FROM ({JOIN_SLIDING_SQL}) p, range(5) r(i) GROUP BY 1, 3""")
def q_join_count_enriched(spark, sf):
    """Joined counts of events that carry their campaign, as the second query of the staged job has them."""
    return count_joined_enriched(enrich(td.ad_events(spark, sf), td.campaigns(spark, sf)), "sliding", SLIDE_SIZE_MS)


# --- campaigns that change, events and malformed records from one pass ----------------------------

NEW_CAMPAIGN = "CASE WHEN c_custkey % 5 = 0 THEN 'n' || CAST(c_custkey % 7 AS VARCHAR) ELSE 'c' || CAST(c_custkey // 10 AS VARCHAR) END"


def _versions(spark, sf) -> str:
    """A campaign table of two versions: every fifth ad gets its campaign (some, another one) in the second."""
    path = scratch_dir(spark, "campaigns")
    table = td.campaigns(spark, sf)
    key = F.col("ad_id").cast("long")
    add_campaigns(table.where(key % 10 != 0), path, 0)
    add_campaigns(table.where(key % 5 == 0).withColumn("campaign_id", F.concat(F.lit("n"), (key % 7).cast("string"))), path, 1)
    return path


@query("campaigns_current", f"SELECT CAST(c_custkey AS VARCHAR) AS ad_id, {NEW_CAMPAIGN} AS campaign_id FROM customer")
def q_campaigns_current(spark, sf):
    return current_campaigns(spark, _versions(spark, sf))


def _ingested(spark, sf) -> str:
    """Two micro-batches of wire records, the first under the first version of the table; the second is run twice."""
    path, camps = scratch_dir(spark, "staged"), _versions(spark, sf)
    wire = td.wire_events(spark, sf)
    first = F.col("offset") % 2 == 0
    ingest.write_batch_once(ingest.both_kinds(wire.where(first), current_campaigns(spark, camps, upto=0)), path, 0)
    for _ in range(2):
        ingest.write_batch_once(ingest.both_kinds(wire.where(~first), current_campaigns(spark, camps)), path, 1)
    return path


@query("ingest_events", f"""
WITH w AS (SELECT event_id, CASE WHEN user_id % 7 = 3 THEN 'x' ELSE '' END || CAST(user_id AS VARCHAR) AS ad_id,
                  epoch_ms(date_trunc('second', ts)) AS t, event_type AS et FROM events WHERE event_type <> 'error')
SELECT w.ad_id, coalesce(CASE WHEN event_id % 2 = 1 THEN {NEW_CAMPAIGN} WHEN c_custkey % 10 <> 0 THEN 'c' || CAST(c_custkey // 10 AS VARCHAR) END,
                         'UNKNOWN') AS campaign_id, t AS ts, et
FROM w LEFT JOIN customer ON w.ad_id = CAST(c_custkey AS VARCHAR)""")
def q_ingest_events(spark, sf):
    return ingest.events(spark, _ingested(spark, sf)).select("ad_id", "campaign_id", "ts", "et")


@query("ingest_malformed", """
SELECT CAST(user_id AS VARCHAR) AS key, CAST(user_id % 4 AS INTEGER) AS "partition", event_id AS "offset",
       CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN '{"ts":1700000000000,"id":"a","et":"view"}'
            WHEN 2 THEN '{"ts":" 1700000000000","id":"a","et":"view"}' ELSE '{"ts":"1700000000000","id":7,"et":"view"}' END AS value
FROM events WHERE event_type = 'error'""")
def q_ingest_malformed(spark, sf):
    return ingest.malformed(spark, _ingested(spark, sf)).select("key", "partition", "offset", "value")
