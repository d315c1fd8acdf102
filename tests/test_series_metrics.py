"""Hand-written fixtures for series, metrics and profiles (FIXTURES.md section 2)."""

import math

import pytest
from pyspark.sql import functions as F

from adflow.operators import metrics as M
from adflow.operators import series as S
from adflow.operators.profiles import PROFILE_COLUMNS, ProfileTable, build_profiles
from adflow.sources import testdata as td
from adflow.sources.series_csv import (read_rate_curve, read_series_csv, read_series_csv_rows,
                                       write_rate_curve, write_series_csv)
from tests.conftest import T0

SCHEMA = "series_id string, ts long, value double"


def ser(spark, pts, sid="s"):
    return spark.createDataFrame([(sid, T0 + t, v) for t, v in pts], SCHEMA)


def pts(df):
    return sorted((r.ts - T0, r.value) for r in df.collect())


def test_grid_and_widths(spark):
    assert S.grid(spark, T0, T0 + 3).count() == 4
    assert S.grid(spark, T0 * 1000, T0 * 1000 + 3000).count() == 4
    with pytest.raises(ValueError):
        S.grid(spark, 10, T0 * 1000)
    b = spark.createDataFrame([(10, T0 * 1000)], "start long, end long")
    with pytest.raises(Exception):
        S.grid_from_bounds(b).collect()


def test_grid_chunks(spark):
    b = spark.createDataFrame([(T0, T0 + 999)], "start long, end long")
    g = S.grid_from_bounds(b, chunk=7)
    assert g.count() == 1000 and g.distinct().count() == 1000


def test_series_csv_reader(spark, tmp_dir):
    path = f"{tmp_dir}/s.csv"
    with open(path, "w") as f:
        f.write("timestamp|value\n")
        for line in [f"{T0}|1.0", f"{T0 + 2}|bad", f"{T0 + 2}|5.0", f"{T0 + 2}|7.0", f"{T0 + 3}|null"]:
            f.write(line + "\n")
    out = pts(read_series_csv(spark, path))
    assert out == [(0, 1.0), (1, None), (2, 7.0), (3, None)]


def test_series_csv_roundtrip(spark, tmp_dir):
    s = ser(spark, [(0, 1.0), (1, None), (2, 1e10)]).select("ts", "value")
    write_series_csv(s, f"{tmp_dir}/out")
    write_series_csv(s, f"{tmp_dir}/out")  # append
    back = read_series_csv_rows(spark, f"{tmp_dir}/out")
    assert sorted(pts(back)) == sorted(pts(s) * 2)


def test_series_csv_appends_are_read_in_order(spark, tmp_dir):
    """The last append wins, and the grid runs to its last line, whatever the files are called."""
    for n in range(5):
        rows = [(n, 10.0 * n), (n + 1, 10.0 * n + 1)]
        write_series_csv(ser(spark, rows).select("ts", "value"), f"{tmp_dir}/s")
    assert pts(read_series_csv(spark, f"{tmp_dir}/s")) == [(0, 0.0), (1, 10.0), (2, 20.0), (3, 30.0), (4, 40.0), (5, 41.0)]
    two = ser(spark, [(0, 1.0), (2, 3.0)], "a").unionByName(ser(spark, [(5, 7.0)], "b"))
    write_series_csv(two, f"{tmp_dir}/many", by=["series_id"])
    write_series_csv(ser(spark, [(1, 2.0), (3, 4.0)], "a"), f"{tmp_dir}/many", by=["series_id"])
    got = sorted((r.series_id, r.ts - T0, r.value) for r in read_series_csv(spark, f"{tmp_dir}/many", by=["series_id"]).collect())
    assert got == [("a", 0, 1.0), ("a", 1, 2.0), ("a", 2, 3.0), ("a", 3, 4.0), ("b", 5, 7.0)]


def test_rate_curve_file_order(spark, tmp_dir):
    curve = spark.createDataFrame([(i, 100 + i, v) for i, v in enumerate([2, 0, 5])], "i long, ts long, value int")
    write_rate_curve(curve, f"{tmp_dir}/curve")
    back = read_rate_curve(spark, f"{tmp_dir}/curve").orderBy("i").collect()
    assert [(r.i, r.value) for r in back] == [(0, 2), (1, 0), (2, 5)]


def test_merge_unaligned(spark):
    a = ser(spark, [(0, 1.0), (1, None), (2, 3.0)]).select("ts", "value")
    b = ser(spark, [(1, None), (2, 4.0), (4, 5.0)]).select("ts", "value")
    assert pts(S.merge(a, b)) == [(0, 1.0), (1, None), (2, 7.0), (3, None), (4, 5.0)]
    assert pts(S.merge(a, b)) == pts(S.merge(b, a))


def test_merge_many_needs_two(spark):
    one = ser(spark, [(0, 1.0)])
    with pytest.raises(Exception):
        S.merge(one).collect()
    many = ser(spark, [(0, 1.0), (1, 2.0)], "a").unionByName(ser(spark, [(1, 3.0)], "b"))
    assert pts(S.merge(many)) == [(0, 1.0), (1, 5.0)]


def test_merge_aligned(spark):
    a = ser(spark, [(0, 1.0), (1, None), (2, 3.0)]).select("ts", "value")
    b = ser(spark, [(0, None), (1, None), (2, 4.0)]).select("ts", "value")
    assert pts(S.merge_aligned(a, b)) == [(0, 1.0), (1, None), (2, 7.0)]
    with pytest.raises(Exception, match="different shape"):
        S.merge_aligned(a, ser(spark, [(0, 1.0), (2, 2.0)]).select("ts", "value")).collect()


def test_resample(spark):
    s = ser(spark, [(i, float(i)) for i in range(10)])
    assert [t for t, _ in pts(S.resample(s, 3, anchor=T0 + 9, limit=2))] == [6, 9]
    assert [t for t, _ in pts(S.resample_irregular(s, 3, anchor=T0 + 9, limit=2, block=4))] == [6, 9]
    # rate 1, no limit: everything up to the anchor
    assert [t for t, _ in pts(S.resample(s, 1, anchor=T0 + 4))] == [0, 1, 2, 3, 4]
    for kept in (s, S.densify(s, keep_bounds=True)):
        with pytest.raises(Exception, match="no point"):
            S.resample(kept, 3, anchor=T0 + 42).collect()
    with pytest.raises(Exception, match="no point"):
        S.resample_irregular(s, 3, anchor=T0 + 42, block=4).collect()
    carried = S.resample(S.densify(s, keep_bounds=True), 3, limit=2)
    assert [t for t, _ in pts(carried)] == [6, 9]
    plan = carried._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1   # the grid's own join only


def test_one_long_series_is_made_by_many_tasks(spark):
    b = spark.createDataFrame([(T0, T0 + 2_000_000)], "start long, end long")
    sizes = [r["count"] for r in S.grid_from_bounds(b).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 2_000_001 and len(sizes) > 1


def test_stats(spark):
    s = ser(spark, [(0, 3.0), (1, None), (2, 5.0)])
    r = S.stats(s).first()
    assert (r.avg, r.sum, r.size, r.min, r.max) == (4.0, 8.0, 3, 0.0, 5.0)
    assert S.stats(s, strict=True).first().min == 3.0
    n = S.stats(ser(spark, [(0, None), (1, None)])).first()
    assert math.isnan(n.avg) and (n.sum, n.min, n.max) == (0.0, 0.0, 0.0)
    nan = S.stats(ser(spark, [(0, float("nan")), (1, 2.0)]), strict=True).first()
    assert (nan.min, nan.max) == (2.0, 2.0)


def test_first_last_lookup_upsert(spark):
    s = ser(spark, [(0, 1.0), (1, 2.0), (2, None)])
    fl = S.first_last(s).first()
    assert (fl.first_value, fl.last_ts - T0, fl.last_value) == (1.0, 2, None)
    keys = spark.createDataFrame([(T0 + 1,), (T0 + 9,)], "ts long")
    assert pts(S.lookup(s.select("ts", "value"), keys)) == [(1, 2.0), (9, None)]
    with pytest.raises(Exception):
        S.lookup(s.select("ts", "value"), keys, missing="raise").collect()
    up = spark.createDataFrame([(T0 + 1, None), (T0 + 2, 9.0)], "ts long, value double")
    assert pts(S.upsert(s.select("ts", "value"), up)) == [(0, 1.0), (1, None), (2, 9.0)]
    bad = spark.createDataFrame([(T0 + 7, 1.0)], "ts long, value double")
    with pytest.raises(Exception):
        S.upsert(s.select("ts", "value"), bad).collect()


def test_values_and_json(spark):
    s = ser(spark, [(0, 1.0), (1, 2.0)])
    v = S.values(s, 10**10).first()["values"]
    assert v == [1.0, 2.0]
    with pytest.raises(Exception):
        S.values(ser(spark, [(0, None)]), 10**10).collect()
    for span in (10**10, 1):   # one chunk, and a chunk a point: the same text
        parts = S.to_json_text(ser(spark, [(0, 1.0), (1, None)]), span).orderBy("chunk").collect()
        assert {p.series_count for p in parts} == {2}
    j = "".join(p.json for p in parts)
    assert j == '{"observations":[{"timestamp":%d,"value":1.0}, {"timestamp":%d,"value":null}],"count":2}' % (T0, T0 + 1)


def samples(spark, rows):
    """rows: (metric, pod, ts offset, value)."""
    return spark.createDataFrame(
        [(m, {"pod": p, "namespace": "default"}, T0 + t, v) for m, p, t, v in rows],
        "metric string, labels map<string,string>, ts long, value double")


def test_matrix_forms(spark):
    docs = spark.createDataFrame([(
        '{"status":"success","data":{"resultType":"matrix","result":['
        '{"metric":{"__name__":"m","pod":"p1"},"values":[[%d,"1.5"],[%d,"NaN"]]},'
        '{"metric":{"__name__":"m","pod":"p2"},"values":[[%d,"2"]]}]}}' % (T0, T0 + 1, T0),)], "json string")
    all_rows = M.explode_matrix(docs).collect()
    assert len(all_rows) == 3 and sorted([r.value for r in all_rows], key=str) == sorted([1.5, None, 2.0], key=str)
    assert len(M.explode_matrix(docs, first_only=True).collect()) == 2
    failed = spark.createDataFrame([('{"status":"error"}',), ("garbage",), (None,)], "json string")
    assert M.explode_matrix(failed).count() == 0
    assert M.failed_documents(docs.unionByName(failed)).count() == 3
    by = M.series_by_label(M.explode_matrix(docs), "pod")
    assert by.count() == 4  # two pods on a 2-point grid


def test_matrix_roundtrip(spark):
    s = samples(spark, [("m", "p1", 0, 1.0), ("m", "p1", 1, None), ("m", "p2", 0, 3.0)])
    back = M.explode_matrix(td.matrix_docs(s))
    assert sorted((r.labels["pod"], r.ts - T0, r.value) for r in back.collect()) == \
        sorted([("p1", 0, 1.0), ("p1", 1, None), ("p2", 0, 3.0)], key=str)


def test_series_that_share_a_label_value_share_a_point(spark):
    """Two label sets with one pod: one row a second, the later series' value; documents are read in their order."""
    doc = ('{"status":"success","data":{"resultType":"matrix","result":['
           '{"metric":{"__name__":"m","pod":"p","job":"%s"},"values":[[%d,"%d"],[%d,"%d"]]}]}}')
    docs = spark.createDataFrame([(2, doc % ("a", T0, 1, T0 + 1, 2)), (1, doc % ("b", T0, 5, T0 + 2, 6))], "n long, json string")
    rows = M.explode_matrix(docs, order="n")
    by = {(r.pod, r.ts - T0): r.value for r in M.series_by_label(rows, "pod").collect()}
    assert by == {("p", 0): 1.0, ("p", 1): 2.0, ("p", 2): 6.0}
    assert M.series_by_label(rows.drop("at"), "pod").where(F.col("ts") == T0).first().value == 5.0
    with pytest.raises(Exception, match="has no label host"):
        M.series_by_label(rows, "host").collect()


def test_first_series(spark):
    s = lab(spark, [("m", {"pod": "b"}, 0, 1.0), ("m", {"pod": "a"}, 1, 2.0), ("m", {"pod": "b"}, 11, 3.0), ("m", {"pod": "c"}, 12, 4.0)])
    assert dict(pts(M.first_series(s, span=10))) == {**{t: None for t in range(13)}, 1: 2.0, 11: 3.0}


def lab(spark, rows):
    return spark.createDataFrame([(m, l, T0 + t, v) for m, l, t, v in rows],
                                 "metric string, labels map<string,string>, ts long, value double")


def test_trailing_max_is_per_series(spark):
    """Two jobs on one pod are two series: their maxima add up."""
    s = lab(spark, [("r", {"pod": "p", "job": "a"}, 0, 1.0), ("r", {"job": "b", "pod": "p"}, 0, 5.0)])
    assert pts(M.trailing_max_sum(s, "r")) == [(0, 6.0)]


def test_label_values_with_separators_are_other_series(spark):
    s = lab(spark, [("r", {"a": "1,b=2"}, 0, 1.0), ("r", {"a": "1", "b": "2"}, 0, 5.0), ("r", {"a": '1","b":"2'}, 0, 10.0)])
    assert pts(M.trailing_max_sum(s, "r")) == [(0, 16.0)]
    assert s.select(M.series_key()).distinct().count() == s.select(M.label_text()).distinct().count() == 3
    none = F.lit(False)
    named = s.withColumn("labels", F.map_concat("labels", F.create_map(F.lit("job"), F.lit("j"))))
    terms = dict.fromkeys(("cpu", "memory", "workers", "source", "sink", "usage", "pinned", "capacity"), none) | {"restarts": "r"}
    import tempfile
    out = M.export_series(named, "job", terms, tempfile.mkdtemp() + "/partials").where("name = 'numRestarts'").collect()
    assert [r.value for r in out] == [16.0]


def test_spans_share_their_edge(spark):
    """A series that begins on a span's last second is that span's first series, if it is first in order."""
    rows = [("m", {"a": "1"}, 10, 100.0)] + [("m", {"a": "2"}, t, float(t)) for t in range(21)]
    got = dict(pts(M.first_series(lab(spark, rows), span=10)))
    assert got == {**dict.fromkeys(range(21)), 10: 100.0, 20: 20.0}
    rows = [("m", {"a": "1"}, 3, 7.0), ("m", {"a": "1"}, 10, None)] + [("m", {"a": "2"}, t, float(t)) for t in range(11, 16)]
    got = dict(pts(M.first_series(lab(spark, [*rows, ("m", {"a": "0"}, 0, 1.0)]), span=10)))
    assert got == {**dict.fromkeys(range(16)), 0: 1.0}   # the second span's first series has a null at 10 and no more
    later = [("m", {"a": "2"}, 0, 1.0), ("m", {"a": "2"}, 10, 2.0), ("m", {"a": "1"}, 10, 3.0), ("m", {"a": "1"}, 12, 4.0)]
    assert dict(pts(M.first_series(lab(spark, later), span=10)))[10] == 3.0


def test_milliseconds_round_up(spark):
    df = spark.createDataFrame([(0,), (1,), (999,), (1000,), (1001,), (None,)], "ms long")
    assert [r[0] for r in df.select(M.seconds_up("ms")).collect()] == [0, 1, 1, 1, 2, None]


def test_json_documents_parse(spark, tmp_path):
    """One document per series: its lines in order parse as one JSON text whose count is right; no line is above a chunk."""
    import glob
    import json
    rows = [("x", T0 + i, None if i % 7 == 0 else i / 3) for i in range(500)] + [("y z/é", T0, 1.0)]
    df = spark.createDataFrame(rows, "series_id string, ts long, value double")
    out = str(tmp_path / "docs")
    S.write_series_json(df.repartition(5), out, chunk_span=20)
    docs = {}
    for folder in glob.glob(f"{out}/series_id=*"):
        lines = "".join(open(f).read() for f in sorted(glob.glob(f"{folder}/part-*"))).splitlines()
        assert all(line.count("timestamp") <= 20 for line in lines)
        docs[folder.rsplit("=")[-1]] = json.loads("".join(lines))
    assert sorted(d["count"] for d in docs.values()) == [1, 500]
    assert [(o["timestamp"], o["value"]) for o in docs["x"]["observations"]] == [r[1:] for r in rows[:500]]
    back = S.read_series_json(spark, out)
    assert sorted([(r.series_id, r.ts, r.value) for r in back.collect()], key=str) == sorted(rows, key=str)
    assert {r.series_id: r.n for r in back.groupBy("series_id").agg(F.max("count").alias("n")).collect()} == {"x": 500, "y z/é": 1}


def test_a_repeated_insert_doubles_nothing(spark, tmp_dir):
    table = ProfileTable(spark, f"{tmp_dir}/p")
    rows = profiles(spark, profile(1, "a"), profile(2, "b"))
    table.insert(rows, run="r1")
    table.insert(rows, run="r1")
    table.insert(profiles(spark, profile(3, "c")), run="r2")
    assert sorted(r.jobId for r in table.read().collect()) == ["a", "b", "c"]
    table.delete(spark.createDataFrame([(1,), (3,)], "e int"))
    table.insert(rows, run="r1")
    assert sorted(r.jobId for r in table.read().collect()) == ["a", "b"]
    table.delete([1, 2])
    assert table.read().count() == 0
    with pytest.raises(ValueError, match="folder"):
        table.insert(rows, run="../x")


def test_delay_of_one_metric_under_two_label_values(spark):
    op = lambda n: {"operator_name": n}
    s = lab(spark, [("mark", op("src"), 0, 5_000_000.0), ("mark", op("snk"), 0, 2_000_000.0), ("w", {}, 0, 2.0),
                    ("mark", op("src"), 1, 2_000_000.0), ("mark", op("snk"), 1, 1_000_000.0), ("w", {}, 1, 2.0)])
    out = dict(pts(M.progress_delay(s, M.selects("mark", op("src")), M.selects("mark", op("snk")), "w")))
    assert out == {0: None, 1: 500.0}
    use = lab(spark, [("u", op("x"), 0, 6.0), ("u", op("y"), 0, 100.0), ("p", op("x"), 0, 2.0), ("c", {}, 0, 4.0), ("w", {}, 0, 2.0)])
    assert pts(M.state_usage(use, M.selects("u", op("x")), M.selects("p", op("x")), "c", "w")) == [(0, 1.0)]


def test_export_is_per_job(spark, tmp_dir):
    rows = [("cpu", {"job": j, "pod": p}, t, 1.0 + (j == "b")) for j in "ab" for p in "pq" for t in range(0, 4, 3 if j == "a" else 1)]
    rows += [("rst", {"job": "a", "pod": "p"}, 0, 3.0), ("rst", {"job": "a", "pod": "q"}, 1, 4.0)]
    none = F.lit(False)
    terms = {"cpu": "cpu", "memory": none, "workers": none, "restarts": "rst", "source": none, "sink": none, "usage": none, "pinned": none, "capacity": none}
    out = M.export_series(lab(spark, rows), "job", terms, f"{tmp_dir}/partials")
    M.export_metrics(out, f"{tmp_dir}/out")
    back = {(r.job_id, r.name, r.ts - T0): r.value for r in M.read_exported(spark, f"{tmp_dir}/out").collect()}
    assert len(back) == 2 * 6 * 4
    assert [back["a", "cpuLoad", t] for t in range(4)] == [2.0, None, None, 2.0]
    assert [back["b", "cpuLoad", t] for t in range(4)] == [4.0] * 4
    assert [back["a", "numRestarts", t] for t in range(4)] == [3.0, 7.0, 7.0, 7.0]
    assert [back["b", "numRestarts", t] for t in range(4)] == [None] * 4


def test_uptime_of_a_series_that_ends_early(spark):
    df = spark.createDataFrame([("j", T0, 7000.0), ("k", T0 + 5, 9000.0)], "job string, ts long, value double")
    assert {r.job: r.uptime_s for r in M.uptime_seconds(df, by=["job"]).collect()} == {"j": 0, "k": 9}


def test_uptime(spark):
    df = spark.createDataFrame([("j", T0, 1000.0), ("j", T0 + 1, 12500.0), ("k", T0, 5.0), ("k", T0 + 1, None)],
                               "job string, ts long, value double")
    out = {r.job: r.uptime_s for r in M.uptime_seconds(df, by=["job"]).collect()}
    assert out == {"j": 12, "k": 0}


def test_delay(spark):
    s = samples(spark, [("src", "p", 0, 5_000_000.0), ("snk", "p", 0, 2_000_000.0), ("w", "p", 0, 2.0),
                        ("src", "p", 1, 2_000_000.0), ("snk", "p", 1, 1_000_000.0), ("w", "p", 1, 2.0)])
    out = dict(pts(M.progress_delay(s, "src", "snk", "w")))
    assert out == {1: 500.0} or out == {0: None, 1: 500.0}


@pytest.mark.parametrize("left_open", [True, False])
@pytest.mark.parametrize("seconds", [1, 7, 50])
def test_trailing_max_steps_brute_force(spark, left_open, seconds):
    """Dense and sparse stretches, nulls, ties, samples on block edges, before and after the grid."""
    import random
    rng = random.Random(seconds)
    at = sorted(rng.sample(range(400), 60) + list(range(100, 130)) + list(range(0, 400, seconds * 4)))
    vals = {(k, t): rng.choice([None, 0.0, 1.0, 2.0, rng.random() * 3, -1.5]) for k in "ab" for t in set(at) if rng.random() < 0.8}
    df = spark.createDataFrame([(k, T0 + t, v) for (k, t), v in vals.items()], "k string, ts long, value double")
    bounds = spark.createDataFrame([("a", T0 + 20, T0 + 380), ("b", T0, T0 + 450)], "k string, start long, end long")
    got = {(r.k, r.ts - T0): r.value for r in M.trailing_max(df, ["k"], bounds, seconds, left_open).collect()}
    reach = seconds - 1 if left_open else seconds
    want = {(k, t): max([v for (o, u), v in vals.items() if o == k and t - reach <= u <= t and v is not None], default=None)
            for k, lo, hi in (("a", 20, 380), ("b", 0, 450)) for t in range(lo, hi + 1)}
    assert got == want
    steps = M.trailing_max_steps(df, ["k"], seconds, left_open).collect()
    covered = [(s.k, t) for s in steps for t in range(s["first"], s["last"] + 1)]
    assert len(covered) == len(set(covered))


@pytest.mark.parametrize("left_open", [True, False])
def test_trailing_max_brute_force(spark, left_open):
    rows = [("r", "p%d" % (i % 2), i * 37 % 900, float((i * 7) % 11)) for i in range(200)]
    rows += [("other", "p0", 950, 1.0)]  # widens the job grid
    s = samples(spark, rows)
    got = dict(pts(M.trailing_max_sum(s, "r", seconds=100, left_open=left_open)))
    reach = 99 if left_open else 100
    want = {}
    for t in range(0, 951):
        tot = None
        for pod in ("p0", "p1"):
            vals = [v for m, p, ts, v in rows if m == "r" and p == pod and t - reach <= ts <= t]
            if vals:
                tot = (tot or 0.0) + max(vals)
        want[t] = tot
    assert got == want


def test_filters_and_usage(spark):
    s = samples(spark, [("u", "pod-0", 0, 1.0), ("p", "pod-0", 0, 1.0), ("c", "pod-0", 0, 4.0),
                        ("w", "pod-0", 0, 2.0), ("u", "pod-1", 0, 2.0), ("u", "other", 0, 9.0)])
    assert pts(M.metric_sum(s, "u", regex={"pod": "pod-[01]"})) == [(0, 3.0)]
    assert pts(M.metric_mean(s, "u", eq={"namespace": "default"})) == [(0, 4.0)]
    assert pts(M.state_usage(s, "u", "p", "c", "w")) == [(0, (12.0 + 1.0) / (4.0 * 2.0))]
    assert sorted(r.pod for r in M.series_keys(s, "pod").collect()) == ["other", "pod-0", "pod-1"]


def profile(exp, job, **more):
    return {c: 0 if c in ("expId", "scaleOut", "workload", "isBckPres", "startTs", "stopTs") else 0.0 for c in PROFILE_COLUMNS} | {
        "expId": exp, "jobId": job, **more}


def profiles(spark, *rows):
    from adflow.operators.profiles import PROFILE_SCHEMA
    return spark.createDataFrame([tuple(r[c] for c in PROFILE_COLUMNS) for r in rows], PROFILE_SCHEMA)


def test_profile_table_is_found_again(spark, tmp_dir):
    root = f"{tmp_dir}/profiles"
    assert ProfileTable(spark, root).read().count() == 0
    first = profiles(spark, profile(1, "a", scaleOut=2, workload=10, avgLat=1.23456789), profile(1, "b", scaleOut=1, workload=5), profile(2, "c"))
    ProfileTable(spark, root).create().insert(first)
    ProfileTable(spark, root).insert(profiles(spark, profile(3, "d", workload=3_000_000_000, cpuTotal=float("inf"))))
    table = ProfileTable(spark, root)
    assert sorted(r.jobId for r in table.read().collect()) == ["a", "b", "c", "d"]
    assert [r.jobId for r in table.select([1]).collect()] == ["b", "a"]
    assert table.read().where("jobId = 'a'").first().avgLat == 1.23456789
    big = table.read().where("jobId = 'd'").first()
    assert big.workload == 3_000_000_000 and math.isinf(big.cpuTotal)
    table.delete_jobs(spark.createDataFrame([(1, "a"), (2, "c"), (9, "z")], "expId int, jobId string"))
    assert sorted(r.jobId for r in ProfileTable(spark, root).read().collect()) == ["b", "d"]
    table.delete([1])
    assert [r.jobId for r in table.read().collect()] == ["d"]
    assert ProfileTable(spark, root).create(exp_id=3).read().count() == 0


def test_profile_needs_every_column(spark, tmp_dir):
    row = profiles(spark, profile(1, "a")).withColumn("avgLat", F.lit(None).cast("double"))
    with pytest.raises(Exception, match="needs avgLat"):
        ProfileTable(spark, f"{tmp_dir}/p").insert(row)


def test_profile_build_keeps_infinity_and_leaves_nulls(spark):
    s = samples(spark, [("cpu", "p", 0, 2.0), ("cpu", "p", 1, float("inf")), ("throughput", "p", 0, 3e9), ("throughput", "q", 0, 1e27)])
    r = build_profiles(s, F.lit(1), F.lit("j")).first()
    assert math.isinf(r.cpuAvg) and math.isinf(r.cpuTotal) and r.avgLat is None and r.scaleOut == 2 and r.avgThr > 4e26
