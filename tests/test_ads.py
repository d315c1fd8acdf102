"""Hand-written fixtures for the ad operators (FIXTURES.md section 2)."""

import pytest
from pyspark.sql import functions as F

from adflow.config import PipelineConfig, parse_bool
from adflow.functions.messages import aggregate_message, event_message, join_message
from adflow.operators.audit import late_audit
from adflow.operators.counts import count_by_campaign, count_joined, count_joined_pairs, count_views
from adflow.operators.enrich import assert_unique, enrich
from adflow.operators.joins import window_join
from adflow.operators.windows import end_ms
from adflow.operators.workload import expand_workload, events_per_second
from adflow.plans.pipeline import build, messages
from adflow.sources.campaigns import build_campaigns, campaign_set
from adflow.sources.events import decode, encode, quarantined, with_event_time
from tests.conftest import T0, T0_MS, ms


def events(spark, rows):
    """rows: (ad_id, seconds offset, et) -> ad events with event_time."""
    df = spark.createDataFrame([(a, ms(s), e) for a, s, e in rows], "ad_id string, ts long, et string")
    return with_event_time(df)


def camps(spark, rows):
    return spark.createDataFrame(rows, "ad_id string, campaign_id string")


def counts(df):
    return sorted((r["campaign_id"], r["count"], r["window_end"]) for r in df.collect())


def test_decode_good_and_extra_field(spark):
    wire = spark.createDataFrame([('{"ts":"1700000000000","id":"a1","et":"view","x":1}',)], "value string")
    row = decode(wire).collect()[0]
    assert (row.ad_id, row.ts, row.et) == ("a1", 1700000000000, "view")


GOOD = '{"ts":"1700000000000","id":"a1","et":"view"}'
BAD = ["bad", "", None, '{"ts":"x","id":"a","et":"view"}', '{"ts":"1","id":"a"}', '{"ts":1700000000000,"id":"a","et":"view"}',
       '{"ts":" 17","id":"a","et":"view"}', '{"ts":"17","id":7,"et":"view"}', '{"ts":"17","id":{"a":1},"et":"view"}',
       '{"ts":"17","id":null,"et":"click"}', '{"ts":"99999999999999999999","id":"a","et":"view"}', "[1]"]


def test_decode_failfast_raises_whatever_is_read(spark):
    for v in BAD:
        df = decode(spark.createDataFrame([(GOOD,), (v,)], "value string"))
        for read in (df.select("ad_id"), df.where("et = 'purchase'"), df.where("et = 'view'").select("event_time"),
                     df.groupBy("et").count()):
            with pytest.raises(Exception, match="malformed"):
                read.collect()
        with pytest.raises(Exception, match="malformed"):
            df.count()


@pytest.mark.parametrize("join,aggregate", [(False, True), (True, False), (True, True)])
def test_job_fails_on_a_malformed_record(spark, join, aggregate):
    from adflow.streaming.runner import job_messages
    cfg = PipelineConfig(apply_join=join, apply_aggregate=aggregate)
    c = camps(spark, [("a1", "c1")])
    for v in BAD:
        wire = spark.createDataFrame([(GOOD, T0), (v, T0 + 1)], "value string, t long").select(
            "value", F.timestamp_seconds("t").alias("timestamp"))
        with pytest.raises(Exception, match="malformed"):
            job_messages(cfg, wire, c).collect()
        assert job_messages(cfg, wire, c, decode_mode="permissive").count() == (0 if join else 1)


def test_decode_quarantine(spark):
    wire = spark.createDataFrame([(v,) for v in BAD + [GOOD]], "value string")
    assert sorted(str(r.value) for r in quarantined(wire.withColumn("key", F.lit("k"))).collect()) == sorted(map(str, BAD))
    assert decode(wire, mode="permissive").count() == 1


def test_encode_roundtrip(spark):
    ev = events(spark, [("a1", 0, "view"), ("a2", 3, "click")])
    enc = encode(ev)
    row = enc.orderBy("key").collect()[0]
    assert row.value == '{"ts":"1700000000000","id":"a1","et":"view"}'
    back = decode(enc).orderBy("ad_id").collect()
    assert [(r.ad_id, r.ts, r.et) for r in back] == [("a1", ms(0), "view"), ("a2", ms(3), "click")]


def test_enrich_unknown(spark):
    ev = events(spark, [("a1", 0, "view"), ("a2", 1, "view"), ("a9", 2, "view")])
    c = camps(spark, [("a1", "c1"), ("a2", "c1")])
    for hint in ("broadcast", "merge"):
        out = enrich(ev, c.hint(hint)).orderBy("ts").collect()
        assert [r.campaign_id for r in out] == ["c1", "c1", "UNKNOWN"]


def test_assert_unique(spark):
    with pytest.raises(ValueError):
        assert_unique(camps(spark, [("a1", "c1"), ("a1", "c2")]))


def test_tumbling_count(spark):
    ev = events(spark, [("a1", 0, "view"), ("a1", 9, "view"), ("a1", 10, "view")])
    c = camps(spark, [("a1", "c1")])
    out = counts(count_views(ev, c, "tumbling", 10_000))
    assert out == sorted([("c1", 2, ms(10)), ("c1", 1, ms(20))])
    assert counts(count_views(ev, c.hint("merge"), "tumbling", 10_000)) == out


def test_sliding_count_five_windows(spark):
    ev = events(spark, [("a1", 0, "view")])
    out = counts(count_views(ev, camps(spark, [("a1", "c1")]), "sliding", 10_000))
    assert [e for _, _, e in out] == [ms(2), ms(4), ms(6), ms(8), ms(10)]


def test_session_count_touching_merge(spark):
    ev = events(spark, [("a1", s, "view") for s in (0, 10, 20, 31)])
    out = counts(count_views(ev, camps(spark, [("a1", "c1")]), "session", 10_000))
    assert out == [("c1", 1, ms(41)), ("c1", 3, ms(30))]


def _join_rows(df):
    return sorted((r.campaign_id, r.ad_id, r.ts_clicked, r.we) for r in
                  df.select("*", end_ms("window").alias("we")).collect())


def test_tumbling_join(spark):
    ev = events(spark, [("a1", 1, "view"), ("a1", 2, "view"), ("a1", 5, "click"), ("a1", 11, "click")])
    c = camps(spark, [("a1", "c1")])
    v = enrich(ev.where("et = 'view'"), c)
    k = ev.where("et = 'click'")
    out = _join_rows(window_join(v, k, "tumbling", 10_000))
    assert out == [("c1", "a1", ms(5), ms(10))] * 2
    assert counts(count_joined(ev.where("et='view'"), k, c, "tumbling", 10_000)) == [("c1", 2, ms(10))]


@pytest.mark.parametrize("click_at,pairs", [(0, 5), (4, 3)])
def test_sliding_join(spark, click_at, pairs):
    ev = events(spark, [("a1", 0, "view"), ("a1", click_at, "click")])
    c = camps(spark, [("a1", "c1")])
    out = window_join(enrich(ev.where("et='view'"), c), ev.where("et='click'"), "sliding", 10_000)
    assert out.count() == pairs


def test_session_join_both_sides(spark):
    ev = events(spark, [("a1", 0, "view"), ("a1", 8, "click"), ("a1", 16, "view")])
    c = camps(spark, [("a1", "c1")])
    v, k = enrich(ev.where("et='view'"), c), ev.where("et='click'")
    out = _join_rows(window_join(v, k, "session", 10_000))
    assert out == [("c1", "a1", ms(8), ms(26))] * 2
    # the co-group form (used on streams) agrees
    from adflow.operators.joins import session_join_grouped
    assert _join_rows(session_join_grouped(v, k, 10_000)) == out


def test_session_join_uses_the_record_time(spark):
    """Payload times one second apart, record times far apart: no session is shared, in either form."""
    from adflow.operators.joins import session_join_grouped
    rows = [("a1", ms(0), T0, "view"), ("a1", ms(1), T0 + 100, "click"), ("a2", ms(0), T0, "view"), ("a2", ms(90), T0 + 10, "click")]
    ev = spark.createDataFrame(rows, "ad_id string, ts long, rt long, et string").withColumn("event_time", F.timestamp_seconds("rt"))
    v, k = enrich(ev.where("et='view'"), camps(spark, [("a2", "c2")])), ev.where("et='click'")
    out = _join_rows(window_join(v, k, "session", 10_000))
    assert out == [("c2", "a2", ms(90), ms(20))] == _join_rows(session_join_grouped(v, k, 10_000))


def test_session_counts_of_a_hot_campaign_are_spread(spark):
    """All misses are one campaign; its sessions come from (campaign, bucket) rows."""
    ev = events(spark, [("a%d" % i, 7 * i, "view") for i in range(300)] + [("b", 5000, "view")])
    out = counts(count_views(ev, camps(spark, []), "session", 10_000))
    assert out == [("UNKNOWN", 1, ms(5010)), ("UNKNOWN", 300, ms(7 * 299 + 10))]


def test_session_join_one_side(spark):
    ev = events(spark, [("a1", 0, "view"), ("a1", 5, "view")])
    c = camps(spark, [("a1", "c1")])
    k = ev.where("et='click'")
    assert window_join(enrich(ev, c), k, "session", 10_000).count() == 0


@pytest.mark.parametrize("kind", ["tumbling", "sliding", "session"])
def test_join_count_precount_equals_pairs(spark, kind):
    rows = [("a%d" % (i % 3), i * 3 % 50, "view" if i % 2 else "click") for i in range(60)]
    ev = events(spark, rows)
    c = camps(spark, [("a0", "c0"), ("a1", "c0")])  # a2 unknown
    v, k = ev.where("et='view'"), ev.where("et='click'")
    assert counts(count_joined(v, k, c, kind, 10_000)) == counts(count_joined_pairs(v, k, c, kind, 10_000))


def test_sliding_counts_sum_to_five_per_event(spark):
    ev = events(spark, [("a1", s, "view") for s in range(0, 100, 3)])
    out = count_views(ev, camps(spark, [("a1", "c1")]), "sliding", 10_000)
    assert out.agg(F.sum("count")).first()[0] == 5 * ev.count()


def test_late_audit(spark):
    rows = [(0, o, ms(s)) for o, s in enumerate([0, 9, 30, 5, 28])]
    df = spark.createDataFrame(rows, "partition int, offset long, ts long")
    for block in (2, 1 << 20):
        out = late_audit(df, 1000, "tumbling", 10_000, block=block).orderBy("offset").collect()
        assert [r.late for r in out] == [False, False, False, True, False]


def test_messages(spark):
    agg = spark.createDataFrame([("c1", 2, 10000)], "campaign_id string, count long, window_end long")
    assert aggregate_message(agg).first().value == "{campaign_id: c1, count: 2, window: 10000}"
    j = spark.createDataFrame([("c1", "a1", 5000)], "campaign_id string, ad_id string, ts_clicked long")
    assert join_message(j).first().value == "{campaign_id: c1, ad_id: a1, ts_clicked: 5000}"
    e = spark.createDataFrame([("a1", 7, "view")], "ad_id string, ts long, et string")
    assert event_message(e).first().value == "{ts:7, id:a1, et:view}"


def test_workload_cap_and_zero(spark):
    curve = spark.createDataFrame([(0, 2), (1, 0), (2, 5), (3, -1)], "i long, value int")
    ads = build_campaigns(spark, 2, 10)
    gen = expand_workload(curve, ads, largest=3, start_ms=T0_MS)
    per = {r.second: r.events for r in events_per_second(gen).collect()}
    assert per == {0: 2, 2: 3}
    assert set(r.et for r in gen.collect()) <= {"view", "click", "purchase"}
    assert gen.where(F.col("second") == 2).select("ts").distinct().first()[0] == T0_MS + 2000


def test_campaign_builder(spark):
    dim = build_campaigns(spark)
    assert dim.count() == 1000 and dim.select("ad_id").distinct().count() == 1000
    assert campaign_set(dim).count() == 100
    bad = dim.where(F.col("campaign_num") != F.floor(F.col("ad_num") / 10)).count()
    assert bad == 0
    assert dim.where(F.length("ad_id") != 16).count() == 0


def test_config_args_and_presets():
    cfg = PipelineConfig.from_args(["j", "b:9092", "in", "out", "5000", "sliding", "10000", "TRUE", "yes"])
    assert cfg.apply_join and not cfg.apply_aggregate and cfg.window_kind == "sliding"
    with pytest.raises(ValueError):
        PipelineConfig.from_args(["too", "few"])
    with pytest.raises(ValueError):
        PipelineConfig(window_kind="hopping")
    with pytest.raises(ValueError):
        PipelineConfig(window_kind="sliding", window_size_ms=4)
    assert parse_bool("True") and not parse_bool("1")


def test_pipeline_modes(spark):
    ev = events(spark, [("a1", 1, "view"), ("a1", 2, "view"), ("a1", 5, "click")])
    c = camps(spark, [("a1", "c1")])
    base = PipelineConfig(window_kind="tumbling", window_size_ms=10_000)
    agg = messages(base, ev, c).first().value
    assert agg == "{campaign_id: c1, count: 2, window: %d}" % ms(10)
    j = messages(PipelineConfig(window_kind="tumbling", window_size_ms=10_000, apply_join=True,
                                apply_aggregate=False), ev, c).collect()
    assert len(j) == 2
    ja = messages(PipelineConfig(window_kind="tumbling", window_size_ms=10_000, apply_join=True,
                                 apply_aggregate=True), ev, c).first().value
    assert ja == "{campaign_id: c1, count: 2, window: %d}" % ms(10)
    none = PipelineConfig(apply_join=False, apply_aggregate=False)
    assert build(none, ev, c).count() == 2
    with pytest.raises(ValueError):
        messages(none, ev, c)


def test_count_by_campaign_on_pairs(spark):
    ev = events(spark, [("a1", 1, "view"), ("a1", 5, "click")])
    c = camps(spark, [("a1", "c1")])
    pairs = window_join(enrich(ev.where("et='view'"), c), ev.where("et='click'"), "tumbling", 10_000)
    assert counts(count_by_campaign(pairs, "tumbling", 10_000)) == [("c1", 1, ms(10))]
