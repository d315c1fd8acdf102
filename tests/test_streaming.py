"""Batch = stream for every window / join plan, restart safety, and the keyed store.

The fixture (sf0.001 ad events) is written as ordered files, followed by two
flush files dated years later that close every window; the stream reads one
file per micro-batch (availableNow), the flush rows are dropped from the
result, and the rest must equal the batch result exactly.
"""

import os
import time

import pytest
from pyspark.sql import functions as F

from adflow.config import PipelineConfig
from adflow.plans.pipeline import build
from adflow.sources import testdata as td
from adflow.sources.events import encode
from adflow.streaming.runner import job_messages, start, use_rocksdb
from adflow.streaming.store import read_latest, store_stream
from adflow.operators.counts import count_views
from adflow.plans.pipeline import prepare

SF = "/root/testdata/sf0.001"
DAY = 86_400_000
FLUSH_MS = (1_893_456_000_000, 1_924_992_000_000)  # 2030-01-01, 2031-01-01
SCHEMA = "ad_id string, ts long, et string"


def write_files(spark, rows_df, folder, n_files=3):
    """Write ``rows_df`` (ad_id, ts, et) as ``n_files`` time-ordered parquet files + 2 flush files."""
    os.makedirs(folder, exist_ok=True)
    pdf = rows_df.select("ad_id", "ts", "et").toPandas().sort_values(["ts", "ad_id", "et"])
    size = (len(pdf) + n_files - 1) // n_files
    chunks = [pdf.iloc[i * size:(i + 1) * size] for i in range(n_files)]
    import pandas as pd
    for ms in FLUSH_MS:
        chunks.append(pd.DataFrame({"ad_id": ["flush"], "ts": [ms], "et": ["view"]}))
    now = time.time() - 100
    for i, c in enumerate(chunks):
        p = os.path.join(folder, f"part-{i:03d}.parquet")
        c.to_parquet(p, index=False)
        os.utime(p, (now + i, now + i))
    return folder


def read_stream(spark, folder):
    return (spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
            .withColumn("event_time", F.timestamp_millis("ts")))


def run_to_end(df, name, checkpoint):
    q = (df.writeStream.outputMode("append").format("memory").queryName(name)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination(300)
    assert q.exception() is None
    return df.sparkSession.table(name)


def rows(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


@pytest.fixture(scope="module")
def replay(spark, tmp_path_factory):
    use_rocksdb(spark)
    ev = td.ad_events(spark, SF).where(F.col("et").isin("view", "click"))
    folder = str(tmp_path_factory.mktemp("replay") / "events")
    write_files(spark, ev, folder)
    batch = spark.createDataFrame(ev.select("ad_id", "ts", "et").collect(), SCHEMA)
    return batch, folder, td.campaigns(spark, SF)


CASES = [
    ("tumbling", DAY, False), ("sliding", 5 * DAY, False), ("session", 7_200_000, False),
    ("tumbling", DAY, True), ("sliding", 5 * DAY, True), ("session", 7_200_000, True),
]


@pytest.mark.parametrize("kind,size,join", CASES)
def test_count_batch_equals_stream(spark, replay, tmp_path, kind, size, join):
    batch_ev, folder, camps = replay
    cfg = PipelineConfig(window_kind=kind, window_size_ms=size, apply_join=join, apply_aggregate=True)
    b = build(cfg, batch_ev, camps)
    s_df = build(cfg, read_stream(spark, folder), camps)
    name = f"c_{kind}_{int(join)}"
    s = run_to_end(s_df, name, str(tmp_path / "ck")).where(F.col("window_end") < FLUSH_MS[0])
    cols = ["campaign_id", "count", "window_end"]
    assert rows(s, cols) == rows(b, cols)
    assert len(rows(b, cols)) > 0


@pytest.mark.parametrize("kind,size", [("tumbling", DAY), ("sliding", 5 * DAY), ("session", 7_200_000)])
def test_join_batch_equals_stream(spark, replay, tmp_path, kind, size):
    batch_ev, folder, camps = replay
    cfg = PipelineConfig(window_kind=kind, window_size_ms=size, apply_join=True, apply_aggregate=False)
    b = build(cfg, batch_ev, camps).select("campaign_id", "ad_id", "ts_clicked",
                                           F.unix_millis("window.end").alias("we"))
    s_df = build(cfg, read_stream(spark, folder), camps).select(
        "campaign_id", "ad_id", "ts_clicked", F.unix_millis("window.end").alias("we"))
    s = run_to_end(s_df, f"j_{kind}", str(tmp_path / "ck"))
    cols = ["campaign_id", "ad_id", "ts_clicked", "we"]
    assert rows(s, cols) == rows(b, cols)
    assert len(rows(b, cols)) > 0


def test_late_rows_dropped(spark, tmp_path):
    """Rows whose window closed at least one micro-batch earlier are dropped."""
    folder = str(tmp_path / "late")
    os.makedirs(folder)
    import pandas as pd
    base = 1_700_000_000_000
    batches = [[0, 9], [30], [35], [5, 38], [100], [FLUSH_MS[0]]]
    now = time.time() - 100
    for i, secs in enumerate(batches):
        ts = [base + s * 1000 if s < 10**6 else s for s in secs]
        p = os.path.join(folder, f"part-{i:03d}.parquet")
        pd.DataFrame({"ad_id": ["a1"] * len(ts), "ts": ts, "et": ["view"] * len(ts)}).to_parquet(p, index=False)
        os.utime(p, (now + i, now + i))
    camps = spark.createDataFrame([("a1", "c1")], "ad_id string, campaign_id string")
    cfg = PipelineConfig(window_kind="tumbling", window_size_ms=10_000)
    out = run_to_end(build(cfg, read_stream(spark, folder), camps), "late", str(tmp_path / "ck"))
    got = {r.window_end: r["count"] for r in out.collect() if r.window_end < FLUSH_MS[0]}
    assert got[base + 10_000] == 2  # the late row at 5 s was dropped


def test_runner_restart_exactly_once(spark, replay, tmp_path):
    """File sink + checkpoint: stop after part of the input, restart, no loss, no duplicate."""
    batch_ev, _, camps = replay
    cfg = PipelineConfig(window_kind="tumbling", window_size_ms=DAY, apply_join=True, apply_aggregate=True)
    wire_dir = str(tmp_path / "wire")
    os.makedirs(wire_dir)
    enc = encode(batch_ev.withColumn("event_time", F.timestamp_millis("ts"))).toPandas()
    enc = enc.sort_values("timestamp")
    import pandas as pd
    flush = pd.DataFrame({"key": ["flush", "flush"], "value": [
        '{"ts":"%d","id":"flush","et":"view"}' % m for m in FLUSH_MS],
        "timestamp": pd.to_datetime(list(FLUSH_MS), unit="ms")})
    for f in (enc, flush):  # parquet TIMESTAMP (UTC, micros), as Spark's TIMESTAMP reads it
        f["timestamp"] = pd.to_datetime(f["timestamp"]).dt.tz_localize("UTC").astype("datetime64[us, UTC]")
    half = len(enc) // 2
    parts = [enc.iloc[:half], enc.iloc[half:], flush.iloc[:1], flush.iloc[1:]]
    now = time.time() - 100
    schema = "key string, value string, timestamp timestamp"

    def put(i):
        p = os.path.join(wire_dir, f"part-{i:03d}.parquet")
        parts[i].to_parquet(p, index=False)
        os.utime(p, (now + i, now + i))

    out_dir, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    for i in (0, 1):
        put(i)
    wire = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(wire_dir)
    q = start(cfg, wire, camps, ck, sink="text", path=out_dir, trigger={"availableNow": True})
    q.awaitTermination(300)
    for i in (2, 3):
        put(i)
    wire = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(wire_dir)
    q = start(cfg, wire, camps, ck, sink="text", path=out_dir, trigger={"availableNow": True})
    q.awaitTermination(300)
    assert q.exception() is None
    got = sorted(r.value for r in spark.read.text(out_dir).collect() if "window: 18934" not in r.value
                 and "window: 1893" not in r.value)
    want = sorted(r.value for r in job_messages(
        cfg, spark.createDataFrame(enc, schema), camps).collect())
    assert got == want


def test_store_stream_latest(spark, replay, tmp_path):
    batch_ev, folder, camps = replay
    counts = count_views(prepare(read_stream(spark, folder).where("et = 'view'"),
                                 PipelineConfig()).select("ad_id", "ts", "event_time"),
                         camps, "tumbling", DAY)
    path = str(tmp_path / "store")
    q = store_stream(counts, path, str(tmp_path / "ck"))
    q.awaitTermination(300)
    assert q.exception() is None
    got = read_latest(spark, path).where(F.col("window_end") < FLUSH_MS[0])
    want = count_views(batch_ev.where("et = 'view'").withColumn("event_time", F.timestamp_millis("ts")),
                       camps, "tumbling", DAY)
    cols = ["campaign_id", "count", "window_end"]
    assert rows(got, cols) == rows(want, cols)


def test_job_from_its_nine_arguments(spark, replay, tmp_path):
    """The program's path: arguments -> replayed files -> exactly-once batches, over a restart."""
    from adflow.sources.campaigns import save_campaigns
    from adflow.streaming.job import launch
    batch_ev, _, camps = replay
    camps_dir, wire_dir, out, ck = (str(tmp_path / n) for n in ("camps", "wire", "out", "ck"))
    save_campaigns(camps, camps_dir)
    enc = encode(batch_ev).unionByName(spark.createDataFrame(
        [("flush", '{"ts":"%d","id":"flush","et":"view"}' % m, m) for m in FLUSH_MS], "key string, value string, t long")
        .select("key", "value", F.timestamp_millis("t").alias("timestamp")))
    args = ["job", "host:1", "in", "out", "1000", "tumbling", str(DAY), "true", "true"]

    def run():
        q = launch(spark, args, camps_dir, ck, source_files=wire_dir, sink="batches", sink_path=out,
                   source_options={"maxFilesPerTrigger": "1"}, trigger={"availableNow": True})
        q.awaitTermination(300)
        assert q.exception() is None

    for part in (enc.where("timestamp < '2024-01-15'"), enc.where("timestamp >= '2024-01-15' AND timestamp < '2030-06-01'"),
                 enc.where("timestamp >= '2030-06-01'")):
        part.select("key", "value", "timestamp").coalesce(1).write.mode("append").parquet(wire_dir)
        run()
    got = sorted(r.value for r in spark.read.text(out).collect() if "window: 1893" not in r.value)
    want = sorted(r.value for r in job_messages(PipelineConfig.from_args(args), encode(batch_ev), camps).collect())
    assert got == want and want


def test_campaigns_are_checked_where_they_are_loaded(spark, tmp_path):
    from adflow.sources.campaigns import load_campaigns
    path = str(tmp_path / "c")
    spark.createDataFrame([("a", "c1"), ("a", "c2")], "ad_id string, campaign_id string").write.parquet(path)
    with pytest.raises(ValueError, match="not unique"):
        load_campaigns(spark, path)


def test_malformed_record_stops_the_stream(spark, tmp_path):
    wire = str(tmp_path / "wire")
    spark.createDataFrame([("k", '{"ts":"1","id":"a","et":"click"}', 0), ("k", '{"ts":"oops","id":"a","et":"view"}', 1)], "key string, value string, t long") \
        .select("key", "value", F.timestamp_seconds("t").alias("timestamp")).coalesce(1).write.parquet(wire)
    camps = spark.createDataFrame([("a", "c")], "ad_id string, campaign_id string")
    for n, (join, aggregate) in enumerate([(False, True), (True, False), (True, True)]):
        stream = spark.readStream.schema("key string, value string, timestamp timestamp").parquet(wire)
        q = start(PipelineConfig(apply_join=join, apply_aggregate=aggregate), stream, camps, str(tmp_path / f"ck{n}"), sink="text",
                  path=str(tmp_path / f"out{n}"), trigger={"availableNow": True})
        with pytest.raises(Exception, match="malformed"):
            q.awaitTermination(120)
