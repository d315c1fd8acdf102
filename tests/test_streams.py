"""Session join in bounded state, hot ads dealt out, campaigns read anew, dead letters, traces, supervision."""

import os
import signal
import threading
import time

import pandas as pd
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from adflow.config import PipelineConfig
from adflow.functions.counting import counted
from adflow.operators import metrics as M
from adflow.operators.counts import count_joined_enriched, count_joined_pairs
from adflow.operators.joins import hot_ads, session_join_bucketed, window_join
from adflow.plans.pipeline import build, prepare
from adflow.sources.campaigns import add_campaigns, current_campaigns
from adflow.sources.events import decode, of_type, project
from adflow.sources.series_csv import read_series_csv
from adflow.streaming import ingest as I
from adflow.streaming.job import launch_ingest, launch_windows
from adflow.streaming.runner import use_rocksdb
from adflow.streaming.session_pairs import session_pairs, state_delay
from adflow.streaming.supervise import TooManyFailures, supervise, supervise_all
from adflow.streaming.trace import BATCHES, LATE, Trace

BASE = 1_700_000_000_000
FLUSH = (1_893_456_000_000, 1_924_992_000_000)
SCHEMA = "ad_id string, ts long, et string"


def put(folder, n, rows):
    """File number ``n`` of events (ad_id, ts, et)."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"part-{n:03d}.parquet")
    pd.DataFrame(rows, columns=["ad_id", "ts", "et"]).astype({"ts": "int64"}).to_parquet(path, index=False)
    os.utime(path, (time.time() - 1000 + n,) * 2)


def flush(folder, n):
    for i, ms in enumerate(FLUSH):
        put(folder, n + i, [("flush", ms, "view")])


def stream(spark, folder):
    return (spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
            .withColumn("event_time", F.timestamp_millis("ts")))


def run(df, name, checkpoint):
    q = (df.writeStream.outputMode("append").format("memory").queryName(name)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination(300)
    assert q.exception() is None
    return df.sparkSession.table(name)


def pairs(df):
    return sorted(tuple(r) for r in df.select("campaign_id", "ad_id", "ts_clicked", F.unix_millis("window.start").alias("s"),
                                              F.unix_millis("window.end").alias("e")).collect())


def sides(ev):
    return (of_type(ev, "view").select("ad_id", F.concat(F.lit("c-"), "ad_id").alias("campaign_id"), "ts", "event_time"),
            project(of_type(ev, "click")))


# -- session join ----------------------------------------------------------------------------------

def test_session_pairs_of_disordered_events(spark, tmp_path):
    """Sessions that meet only through a later batch, one-sided ones, several campaigns of an ad, ties."""
    use_rocksdb(spark)
    gap, delay = 1000, 5000
    batches = [[("a", 0, "view"), ("a", 900, "click"), ("b", 0, "click"), ("a", 4000, "view"), ("a", 4000, "click")],
               [("a", 1900, "click"), ("a", 2900, "view"), ("b", 100, "click"), ("c", 4000, "view")],
               [("a", 3500, "view"), ("a", 3500, "click"), ("a", 3500, "click")],                     # joins all of a
               [("b", 6000, "view"), ("b", 7000, "click"), ("a", 20_000, "click"), ("a", 21_001, "view")],
               [("d", 19_500, "view"), ("d", 19_400, "click")]]
    folder = str(tmp_path / "in")
    for n, rows in enumerate(batches):
        put(folder, n, [(a, BASE + t, e) for a, t, e in rows])
    flush(folder, len(batches))
    ev = stream(spark, folder).withWatermark("event_time", f"{state_delay(delay, gap)} milliseconds")
    got = pairs(run(window_join(*sides(ev), "session", gap), "s_pairs", str(tmp_path / "ck")))
    flat = spark.createDataFrame([(a, BASE + t, e) for rows in batches for a, t, e in rows], SCHEMA) \
        .withColumn("event_time", F.timestamp_millis("ts"))
    want = pairs(session_join_bucketed(*sides(flat), gap))
    assert got == want
    assert {r[1] for r in want} == {"a", "b", "d"} and ("c-a", "a", BASE + 900, BASE, BASE + 5000) in want


def test_session_of_an_ad_that_never_pauses(spark, tmp_path):
    """10**5 events of one ad without a pause: the same pairs, and no state row larger than a chunk."""
    use_rocksdb(spark)
    gap, n = 2000, 100_000
    folder, ck = str(tmp_path / "in"), str(tmp_path / "ck")
    rows = [("hot", BASE + i * 10, "click" if i % 1000 else "view") for i in range(n)]
    for k in range(4):
        put(folder, k, rows[k * n // 4:(k + 1) * n // 4])
    ev = stream(spark, folder).withWatermark("event_time", f"{state_delay(1000, gap)} milliseconds")
    v, c = sides(ev)
    count = window_join(v, c, "session", gap)
    run(count, "hot_open", ck)
    assert spark.table("hot_open").count() == 0   # the session is open: everything waits in state
    state = spark.read.format("statestore").option("stateVarName", "clicks").load(ck)
    sizes = state.select(F.length("user_map_value.ts").alias("n")).agg(F.max("n"), F.sum("n"), F.count("n")).first()
    assert sizes[0] <= 512 * 8 and sizes[1] == (n - n // 1000) * 8 and sizes[2] >= 190
    flush(folder, 4)
    ev = stream(spark, folder).withWatermark("event_time", f"{state_delay(1000, gap)} milliseconds")
    out = str(tmp_path / "out")
    q = (window_join(*sides(ev), "session", gap).writeStream.option("checkpointLocation", ck)
         .foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")).trigger(availableNow=True).start())
    q.awaitTermination(300)
    assert q.exception() is None
    got = spark.read.parquet(out)
    assert got.count() == (n // 1000) * (n - n // 1000)
    one = got.groupBy("ts_clicked").count().agg(F.min("count"), F.max("count"), F.count("count")).first()
    assert tuple(one) == (n // 1000, n // 1000, n - n // 1000)
    assert [tuple(r) for r in got.select("campaign_id", F.unix_millis("window.start"), F.unix_millis("window.end")).distinct().collect()] == \
        [("c-hot", BASE, BASE + (n - 1) * 10 + gap)]
    assert spark.read.format("statestore").option("stateVarName", "clicks").load(ck).count() == 0


def test_watermark_of_the_session_join_is_late_enough(spark, tmp_path):
    cfg = PipelineConfig(window_kind="session", window_size_ms=4000, apply_join=True, apply_aggregate=False)
    os.makedirs(tmp_path / "in")
    plan = prepare(stream(spark, str(tmp_path / "in")), cfg)._jdf.queryExecution().analyzed().toString()
    assert "EventTimeWatermark" in plan and "5 seconds" in plan


# -- hot ads ---------------------------------------------------------------------------------------

@pytest.mark.parametrize("kind,size", [("tumbling", 2000), ("sliding", 5000)])
def test_hot_ad_is_dealt_out(spark, tmp_path, kind, size):
    """One ad with half of all events: the pairs of the plain join, and no state partition above twice the median."""
    use_rocksdb(spark)
    rows = []
    for i in range(1500):
        rows.append(("hot", BASE + i * 70, "view" if i % 3 else "click"))
        rows.append((f"ad{i % 150}", BASE + i * 70 + 1, "click" if i % 2 else "view"))
    folder, ck = str(tmp_path / "in"), str(tmp_path / "ck")
    put(folder, 0, rows)
    flat = spark.createDataFrame(rows, SCHEMA).withColumn("event_time", F.timestamp_millis("ts"))
    hot = hot_ads(flat, 0.1)
    assert [r.ad_id for r in hot.collect()] == ["hot"]
    hot = spark.createDataFrame([("hot",)], "ad_id string")
    v, c = sides(flat)
    want = pairs(window_join(v, c, kind, size))
    assert pairs(window_join(v, c, kind, size, hot=hot, cells=4)) == want

    def sizes(hot, name):
        ev = stream(spark, folder).withWatermark("event_time", "1 second")
        run(window_join(*sides(ev), kind, size, hot=hot), name, f"{ck}-{name}")   # nothing is flushed: all is held
        n = [0] * 4
        for side in ("left", "right"):
            held = spark.read.format("statestore").option("joinSide", side).load(f"{ck}-{name}")
            for r in held.groupBy("partition_id").count().collect():
                n[r.partition_id] += r["count"]
        return sorted(n)

    plain, dealt = sizes(None, f"plain_{kind}"), sizes(hot, f"dealt_{kind}")
    assert dealt[-1] <= 2 * (dealt[1] + dealt[2]) / 2
    assert dealt[-1] / sum(dealt) < plain[-1] / sum(plain) or plain[-1] <= 1.2 * plain[0]
    flush(folder, 1)
    ev = stream(spark, folder).withWatermark("event_time", "1 second")
    assert pairs(run(window_join(*sides(ev), kind, size, hot=hot), f"again_{kind}", str(tmp_path / "ck2"))) == want


# -- ingest: campaigns read anew, malformed records aside ------------------------------------------

WIRE = "key string, value string, timestamp timestamp"


def wire_file(spark, folder, n, records):
    """records: (ad, second, type) or a raw text."""
    rows = [(None, r, BASE) if isinstance(r, str) else
            (r[0], '{"ts":"%d","id":"%s","et":"%s"}' % (BASE + r[1] * 1000, r[0], r[2]), BASE + r[1] * 1000) for r in records]
    df = spark.createDataFrame(rows, "key string, value string, t long").select("key", "value", F.timestamp_millis("t").alias("timestamp"))
    os.makedirs(folder, exist_ok=True)
    pdf = df.toPandas()
    pdf["timestamp"] = pdf["timestamp"].dt.tz_localize("UTC").astype("datetime64[us, UTC]")
    path = os.path.join(folder, f"part-{n:03d}.parquet")
    pdf.to_parquet(path, index=False)
    os.utime(path, (time.time() - 1000 + n,) * 2)


def test_an_ad_added_while_the_job_runs(spark, tmp_path):
    """Misses are UNKNOWN until the ad is there, then the campaign; good and malformed records once each, over restarts."""
    wire, camps, staged, ck = (str(tmp_path / n) for n in ("wire", "camps", "staged", "ck"))
    add_campaigns(spark.createDataFrame([("a", "c1")], "ad_id string, campaign_id string"), camps, 0)

    def go():
        df = spark.readStream.schema(WIRE).option("maxFilesPerTrigger", 1).parquet(wire)
        q = I.ingest(df, camps, staged, ck, trigger={"availableNow": True})
        q.awaitTermination(300)
        assert q.exception() is None

    wire_file(spark, wire, 0, [("a", 0, "view"), ("b", 1, "view"), "oops", ("b", 2, "click")])
    go()
    add_campaigns(spark.createDataFrame([("b", "c2")], "ad_id string, campaign_id string"), camps, 1)
    wire_file(spark, wire, 1, [("b", 3, "view"), '{"ts":1,"id":"a","et":"view"}'])
    go()
    add_campaigns(spark.createDataFrame([("a", "c9")], "ad_id string, campaign_id string"), camps, 2)
    wire_file(spark, wire, 2, [("a", 4, "view"), ("x", 5, "view")])
    go()
    go()   # nothing new
    got = sorted((r.ad_id, r.ts - BASE, r.et, r.campaign_id) for r in I.events(spark, staged).collect())
    assert got == [("a", 0, "view", "c1"), ("a", 4000, "view", "c9"), ("b", 1000, "view", "UNKNOWN"), ("b", 2000, "click", "UNKNOWN"),
                   ("b", 3000, "view", "c2"), ("x", 5000, "view", "UNKNOWN")]
    assert sorted(r.value for r in I.malformed(spark, staged).collect()) == sorted(["oops", '{"ts":1,"id":"a","et":"view"}'])
    assert {r.ad_id: r.campaign_id for r in current_campaigns(spark, camps, upto=1).collect()} == {"a": "c1", "b": "c2"}


def test_a_repeated_batch_writes_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("event", 1)], "kind string, n int")
    path = str(tmp_path / "out")
    assert I.write_batch_once(rows, path, 3)
    assert not I.write_batch_once(rows.withColumn("n", F.lit(2)), path, 3)
    assert [r.n for r in spark.read.parquet(f"{path}/batch=000000003").collect()] == [1]


def test_one_parse_for_both_kinds(spark):
    rows = spark.range(3).select(F.col("id").cast("string").alias("value"), F.timestamp_seconds("id").alias("timestamp"))
    camps = spark.createDataFrame([("a", "c")], "ad_id string, campaign_id string")
    plan = I.both_kinds(rows, camps)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson(") == 1 and plan.count("try_variant_get(") == 6


@pytest.mark.parametrize("join,aggregate,kind", [(False, True, "tumbling"), (True, True, "sliding"), (True, False, "tumbling"),
                                                 (True, False, "session")])
def test_staged_job_over_restarts(spark, tmp_path, join, aggregate, kind):
    """Both queries of the staged job, restarted after each file, give what the whole input gives at once."""
    wire, camps, staged, out, ck = (str(tmp_path / n) for n in ("wire", "camps", "staged", "out", "ck"))
    add_campaigns(spark.createDataFrame([("a", "c1"), ("b", "c2")], "ad_id string, campaign_id string"), camps, 0)
    size = 10_000
    args = ["job", "host:1", "in", "out", "1000", kind, str(size), str(join), str(aggregate)]
    files = [[("a", 0, "view"), ("a", 3, "click"), ("z", 4, "view"), "bad"], [("a", 12, "click"), ("b", 13, "view"), ("b", 14, "click")],
             [("z", 31, "view"), ("z", 31, "click"), ("z", 32, "click")]]
    for n, records in enumerate([*files, [("flush", (FLUSH[0] - BASE) // 1000, "view")], [("flush", (FLUSH[1] - BASE) // 1000, "view")]]):
        if n == 2:
            add_campaigns(spark.createDataFrame([("z", "c3")], "ad_id string, campaign_id string"), camps, 1)
        wire_file(spark, wire, n, records)
        q = launch_ingest(spark, args, camps, staged, f"{ck}/i", source_files=wire, trigger={"availableNow": True})
        q.awaitTermination(300)
        assert q.exception() is None
        q = launch_windows(spark, args, staged, f"{ck}/w", sink="batches", sink_path=out, trigger={"availableNow": True})
        q.awaitTermination(300)
        assert q.exception() is None
    got = sorted(r.value for r in spark.read.text(out).collect() if "flush" not in r.value and "window: 1893" not in r.value)
    flat = I.events(spark, staged).where("ad_id <> 'flush'")
    from adflow.plans.pipeline import as_messages, build_enriched
    cfg = PipelineConfig.from_args(args)
    want = sorted(r.value for r in as_messages(cfg, build_enriched(cfg, flat)).collect())
    assert got == want and want
    if not aggregate:
        assert any("c3" in v for v in want) and I.malformed(spark, staged).count() == 1


@pytest.mark.parametrize("staged", [True, False])
def test_the_program_until_it_is_told_to_stop(spark, tmp_path, staged):
    """Both forms of the program from its arguments: it writes its messages, and a signal removes the checkpoints."""
    from adflow.sources.campaigns import save_campaigns
    from adflow.streaming import job
    wire, camps, out, ck = (str(tmp_path / n) for n in ("wire", "camps", "out", "ck"))
    dim = spark.createDataFrame([("a", "c1")], "ad_id string, campaign_id string")
    if staged:
        add_campaigns(dim, camps, 0)
    else:
        save_campaigns(dim, camps)
    wire_file(spark, wire, 0, [("a", 0, "view"), ("a", 1, "view"), ("x", 2, "view")])
    for n, ms in enumerate(FLUSH):
        wire_file(spark, wire, 1 + n, [("a", (ms - BASE) // 1000, "view")])
    argv = ["job", "host:1", "in", "out", "500", "tumbling", "10000", "false", "true", "--campaigns", camps, "--checkpoint", ck,
            "--source-files", wire, "--sink", "batches", "--sink-path", out, *(["--staged", str(tmp_path / "staged")] if staged else [])]

    def written():
        try:
            return sorted(r.value for r in spark.read.text(out).collect() if "window: 189" not in r.value)
        except Exception:  # noqa: BLE001  nothing there yet
            return []

    def stop_when_done():
        until = time.time() + 90
        while time.time() < until and len(written()) < 2:
            time.sleep(1)
        os.kill(os.getpid(), signal.SIGTERM)

    before = {n: signal.getsignal(n) for n in (signal.SIGINT, signal.SIGTERM)}
    try:
        signal.signal(signal.SIGTERM, signal.SIG_IGN)
        threading.Thread(target=stop_when_done).start()
        job.main(argv)
    finally:
        for n, handler in before.items():
            signal.signal(n, handler)
    end = BASE - BASE % 10_000 + 10_000
    assert written() == [f"{{campaign_id: UNKNOWN, count: 1, window: {end}}}", f"{{campaign_id: c1, count: 2, window: {end}}}"]
    assert not os.path.exists(f"{ck}/ingest" if staged else ck) and not os.path.exists(f"{ck}/windows")


def test_joined_counts_of_enriched_events(spark):
    rows = [("a", "c1", "view", 0), ("a", "c2", "view", 1), ("a", "c2", "view", 2), ("a", "c1", "click", 3), ("a", "c2", "click", 4),
            ("b", "c1", "view", 0), ("c", "c1", "click", 0)]
    ev = spark.createDataFrame([(a, c, e, BASE + t * 1000) for a, c, e, t in rows], "ad_id string, campaign_id string, et string, ts long") \
        .withColumn("event_time", F.timestamp_millis("ts"))
    for kind in ("tumbling", "sliding"):
        got = sorted(tuple(r) for r in count_joined_enriched(ev, kind, 20_000).collect())
        joined = window_join(of_type(ev, "view").select("ad_id", "campaign_id", "ts", "event_time"), project(of_type(ev, "click")), kind, 20_000)
        from adflow.operators.counts import count_by_campaign
        assert got == sorted(tuple(r) for r in count_by_campaign(joined, kind, 20_000).collect()) and got
    assert count_joined_pairs  # the literal plan of un-enriched events is tested in test_ads


# -- traces ----------------------------------------------------------------------------------------

def test_skipped_lines_and_documents_are_counted(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.csv").write_text("timestamp|value\n1700000000|1\nx|2\n1700000001\n1700000002|y\n1700000003|4\n")
    seen = Observation()
    assert len(read_series_csv(spark, str(tmp_path / "s"), skipped=seen).collect()) == 4
    assert seen.get == {"rows": 5, "unparsed": 3}
    docs = spark.createDataFrame([('{"status":"error"}',), ("garbage",), (
        '{"status":"success","data":{"resultType":"matrix","result":[{"metric":{"__name__":"m"},"values":[[1700000000,"1"]]}]}}',)], "json string")
    failed = Observation()
    assert len(M.explode_matrix(docs, skipped=failed).collect()) == 1
    assert failed.get == {"rows": 3, "failed": 2}
    bad = Observation()
    wire = spark.createDataFrame([('{"ts":"1","id":"a","et":"view"}',), ("{",)], "value string")
    assert len(decode(wire, mode="permissive", skipped=bad).collect()) == 1 and bad.get == {"rows": 2, "malformed": 1}
    assert counted(docs, None) is docs


def test_trace_of_a_stream(spark, tmp_path):
    """Malformed records and rows behind the watermark, added up over batches and a restart."""
    use_rocksdb(spark)
    wire, ck = str(tmp_path / "wire"), str(tmp_path / "ck")
    wire_file(spark, wire, 0, [("a", 0, "view"), "bad"])
    wire_file(spark, wire, 1, [("a", 100, "view")])
    wire_file(spark, wire, 2, [("a", 101, "view")])
    wire_file(spark, wire, 3, [("a", 1, "view"), ("a", 2, "view"), ("a", 15, "view"), "bad", "worse"])   # behind the watermark
    camps = spark.createDataFrame([("a", "c")], "ad_id string, campaign_id string")
    cfg = PipelineConfig(window_kind="tumbling", window_size_ms=10_000)

    def go():
        df = spark.readStream.schema(WIRE).option("maxFilesPerTrigger", 1).parquet(wire)
        out = build(cfg, decode(df, mode="permissive", skipped="decode"), camps)
        q = (out.writeStream.outputMode("append").format("noop").option("checkpointLocation", ck).trigger(availableNow=True).start())
        q.awaitTermination(300)
        return q

    with Trace(spark) as trace:
        go()
        wire_file(spark, wire, 4, [("a", 3, "view"), "bad"])
        seen = trace.of(go())
    assert seen["decode"] == {"rows": 11, "malformed": 4}
    assert seen[LATE]["rows"] == 3   # two of the four make one row of the partial count
    assert seen[BATCHES]["rows"] >= 5


# -- supervision -----------------------------------------------------------------------------------

class Flaky:
    """A query over numbered files whose batches fail as told: ``fails`` maps a batch to a number of failures."""

    def __init__(self, spark, tmp_path, files, fails, sleep=0.0):
        self.spark, self.folder, self.ck = spark, str(tmp_path / "in"), str(tmp_path / "ck")
        self.fails, self.sleep, self.done = dict(fails), sleep, []
        for n in range(files):
            put(self.folder, n, [(f"a{n}", BASE + n, "view")])

    def start(self, **trigger):
        def batch(df, n):
            if self.fails.get(n, 0):
                self.fails[n] -= 1
                raise RuntimeError(f"batch {n} fails")
            time.sleep(self.sleep)
            self.done.append(n)

        return (stream(self.spark, self.folder).writeStream.foreachBatch(batch).option("checkpointLocation", self.ck)
                .trigger(**(trigger or {"availableNow": True})).start())


def test_two_failures_are_borne(spark, tmp_path):
    job = Flaky(spark, tmp_path, 4, {1: 2, 3: 3})
    out = supervise(spark, job.start, job.ck)
    assert out.state == "finished" and out.starts == 6 and len(out.failures) == 5
    assert job.done == [0, 1, 2, 3] and os.path.isdir(job.ck)


def test_four_failures_in_a_row_stop_the_job(spark, tmp_path):
    job = Flaky(spark, tmp_path, 3, {1: 4})
    with pytest.raises(TooManyFailures, match="4 failures"):
        supervise(spark, job.start, job.ck)
    assert job.done == [0] and os.path.isdir(job.ck)
    assert supervise(spark, job.start, job.ck).state == "finished" and job.done == [0, 1, 2]


def test_a_batch_beyond_its_time_is_a_failure(spark, tmp_path):
    job = Flaky(spark, tmp_path, 1, {}, sleep=30.0)
    with pytest.raises(TooManyFailures) as e:
        supervise(spark, job.start, job.ck, tolerated=0, batch_seconds=1.5)
    assert "more than 1.5 s" in str(e.value.__cause__)


def test_cancel_removes_the_checkpoint(spark, tmp_path):
    job, cancel = Flaky(spark, tmp_path, 2, {}), threading.Event()
    threading.Timer(6.0, cancel.set).start()
    out = supervise(spark, lambda: job.start(processingTime="200 milliseconds"), job.ck, cancel=cancel)
    assert out.state == "cancelled" and job.done == [0, 1] and not os.path.exists(job.ck)


def test_one_query_gives_up_and_the_others_stop(spark, tmp_path):
    for n in ("x", "y"):
        (tmp_path / n).mkdir()
    good, bad = Flaky(spark, tmp_path / "x", 1, {}), Flaky(spark, tmp_path / "y", 1, {0: 9})
    with pytest.raises(TooManyFailures):
        supervise_all(spark, [(good.ck, lambda: good.start(processingTime="200 milliseconds")), (bad.ck, bad.start)],
                      threading.Event())
    assert os.path.isdir(good.ck) and os.path.isdir(bad.ck)


def test_session_pairs_needs_no_import_on_workers(spark):
    """The state class travels by value: executors need not have this package."""
    import pickle
    from pyspark import cloudpickle
    from adflow.streaming.session_pairs import _processor
    data = cloudpickle.dumps(_processor(1000, 8, 8))
    assert b"adflow.streaming.session_pairs" not in data or pickle.loads(data)
    assert session_pairs


def test_session_pairs_of_many_ads_share_state_rows(spark, tmp_path):
    """3 000 ads of a few events: their clicks lie in a row a group of ads, and the pairs are those of the batch form."""
    from adflow.streaming.session_pairs import GROUPS
    use_rocksdb(spark)
    gap, folder, ck = 1000, str(tmp_path / "in"), str(tmp_path / "ck")
    rows = [(f"a{i}", BASE + (i * 37) % 1000 + k * (700 + 300 * (i % 3)), "click" if (i + k) % 2 else "view")
            for i in range(3000) for k in range(4)]
    put(folder, 0, rows)

    ev = stream(spark, folder).withWatermark("event_time", f"{state_delay(5000, gap)} milliseconds")
    assert run(window_join(*sides(ev), "session", gap), "many_open", ck).count() == 0
    held = spark.read.format("statestore").option("stateVarName", "clicks").load(ck)
    assert held.agg(F.sum(F.length("user_map_value.ts"))).first()[0] == 6000 * 8 and held.count() <= GROUPS
    flush(folder, 1)
    ev = stream(spark, folder).withWatermark("event_time", f"{state_delay(5000, gap)} milliseconds")
    out = str(tmp_path / "out")
    q = (window_join(*sides(ev), "session", gap).writeStream.option("checkpointLocation", ck)
         .foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")).trigger(availableNow=True).start())
    q.awaitTermination(300)
    assert q.exception() is None
    flat = spark.createDataFrame(rows, SCHEMA).withColumn("event_time", F.timestamp_millis("ts"))
    want = pairs(session_join_bucketed(*sides(flat), gap))
    assert pairs(spark.read.parquet(out)) == want and len(want) > 3000
    for name in ("open", "views", "clicks"):
        assert {r[0] for r in spark.read.format("statestore").option("stateVarName", name).load(ck).select("key.ads").distinct().collect()} <= \
            {r[0] for r in spark.sql(f"SELECT pmod(xxhash64('flush'), {GROUPS})").collect()}


def test_replay_has_a_part_of_time_in_each_micro_batch(spark, tmp_path):
    """Every part lies in several files, even of a few events, and all of one micro-batch are of one part."""
    from adflow.plans.stream_queries import replayed, stream_session
    own = stream_session(spark)
    files = int(own.conf.get("spark.sql.shuffle.partitions"))
    flat = own.createDataFrame([(f"a{i}", BASE + i * 1000, "click") for i in range(40)], SCHEMA).withColumn("event_time", F.timestamp_millis("ts"))
    seen = []
    q = (replayed(own, flat).writeStream.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True)
         .foreachBatch(lambda df, n: seen.append((len(df.inputFiles()), sorted(r.ts for r in df.where("ad_id <> 'flush'").collect())))).start())
    q.awaitTermination(300)
    assert q.exception() is None
    assert files > 1 and [s[1] for s in seen] == [[BASE + i * 1000 for i in range(20)], [BASE + i * 1000 for i in range(20, 40)], [], []]
