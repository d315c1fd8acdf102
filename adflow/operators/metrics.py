"""Metric analysis over labelled samples ``(metric, labels MAP, ts, value)``.

Samples come from range-query matrix documents (``status``/``data.result[]``
with a label map and ``[ts, "value"]`` pairs); ``NaN`` becomes null.  The
fixed metric expressions of the experiment are offered as DataFrame
operators: filtered sums and means per timestamp, per-label series on a grid,
the trailing-max-then-sum of restarts, progress delay, state usage and uptime.
Timestamps are epoch seconds on a 1-second grid.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from adflow.functions.counting import counted
from adflow.operators.series import densify, grid_from_bounds, step_of

MATRIX_SCHEMA = (
    "status STRING, data STRUCT<resultType: STRING, "
    "result: ARRAY<STRUCT<metric: MAP<STRING, STRING>, values: ARRAY<ARRAY<STRING>>>>>"
)
SPAN_POINTS = 11_000  # points per range-query document


def nan_to_null(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def series_key(labels: Column | str = "labels") -> Column:
    """The label set as its entries in order of the names: what tells series apart, whatever the values hold."""
    labels = F.col(labels) if isinstance(labels, str) else labels
    return F.array_sort(F.transform(F.map_entries(labels), lambda e: F.struct(
        e["key"].alias("name"), F.coalesce(e["value"], F.lit("")).alias("value"))))


def label_text(labels: Column | str = "labels") -> Column:
    """The label set as a JSON object, names in order."""
    return F.to_json(F.map_from_entries(series_key(labels)))


def seconds_up(ms: Column | str) -> Column:
    """Epoch milliseconds -> whole seconds, rounded up (the bounds of a job in its time series)."""
    ms = F.col(ms) if isinstance(ms, str) else ms
    return F.ceil(ms / F.lit(1000.0)).cast("long")


# --- matrix documents ---------------------------------------------------------------

def _matrix(docs: DataFrame, col: str) -> DataFrame:
    parsed = F.from_json(F.col(col), MATRIX_SCHEMA)
    return docs.withColumn("__m", parsed).withColumn(
        "__ok", F.coalesce(F.lower(F.col("__m.status")) == "success", F.lit(False)))


def explode_matrix(docs: DataFrame, col: str = "json", first_only: bool = False,
                   order: str | None = None, skipped: str | Observation | None = None) -> DataFrame:
    """Documents -> ``(metric, labels, ts, value, at)``; see :func:`failed_documents` for the others, which
    ``skipped`` counts (``rows``: documents, ``failed``: those that give nothing).

    ``at`` is the place of the point's series: the document's ``order`` (a long
    column, 0 without one) and the number of the series in it.  ``first_only``
    keeps only the first result series of each document (the single-series form
    of the range query).
    """
    place = F.col(order).cast("long") if order else F.lit(0).cast("long")
    read = counted(_matrix(docs, col), skipped, failed=~F.col("__ok"))
    r = read.where("__ok").select(place.alias("__doc"), F.posexplode("__m.data.result").alias("__pos", "r"))
    if first_only:
        r = r.where(F.col("__pos") == 0)
    pts = r.select("__doc", "__pos", F.col("r.metric").alias("__labels"), F.explode("r.values").alias("v"))
    return pts.select(
        F.col("__labels")["__name__"].alias("metric"),
        F.map_filter("__labels", lambda k, v: k != "__name__").alias("labels"),
        F.expr("CAST(try_cast(v[0] AS DOUBLE) AS BIGINT)").alias("ts"),
        nan_to_null(F.expr("try_cast(v[1] AS DOUBLE)")).alias("value"),
        F.struct(F.col("__doc").alias("doc"), F.col("__pos").alias("result")).alias("at"),
    )


def failed_documents(docs: DataFrame, col: str = "json") -> DataFrame:
    """The documents that :func:`explode_matrix` gives nothing for: not to be parsed, or not a success."""
    return _matrix(docs, col).where("NOT __ok").select(*docs.columns)


# --- selection ------------------------------------------------------------------------

def selects(metric: str | None = None, eq: Mapping[str, str] | None = None,
            regex: Mapping[str, str] | None = None) -> Column:
    """A sample predicate: metric name, exact ``eq`` and fully anchored ``regex`` label matches.

    Usable as a filter and as a term of :func:`progress_delay` and :func:`state_usage`.
    """
    cond = F.lit(True)
    if metric is not None:
        cond = cond & (F.col("metric") == metric)
    for k, v in (eq or {}).items():
        cond = cond & F.coalesce(F.col("labels")[k] == F.lit(v), F.lit(False))
    for k, r in (regex or {}).items():
        cond = cond & F.coalesce(F.col("labels")[k], F.lit("")).rlike(f"^(?:{r})$")
    return cond


def where_labels(df: DataFrame, metric: str | None = None, eq: Mapping[str, str] | None = None,
                 regex: Mapping[str, str] | None = None) -> DataFrame:
    """The samples that :func:`selects`."""
    return df.where(selects(metric, eq, regex))


Term = Column | str   # a predicate, or the name of a metric


def _picked(term: Term, value: str = "value") -> Column:
    return F.when(selects(term) if isinstance(term, str) else term, F.col(value))


def series_keys(df: DataFrame, label: str) -> DataFrame:
    return df.select(F.col("labels")[label].alias(label)).where(F.col(label).isNotNull()).distinct()


def job_bounds(df: DataFrame) -> DataFrame:
    return df.agg(F.min("ts").alias("start"), F.max("ts").alias("end"))


def on_grid(per_ts: DataFrame, bounds: DataFrame | None) -> DataFrame:
    """Lay a ``(ts, value)`` result on the job grid (points without a sample are null)."""
    if bounds is None:
        return per_ts
    return densify(per_ts, by=(), bounds=bounds)


# --- aggregate expressions per timestamp -------------------------------------------------

def metric_sum(df: DataFrame, metric: str, eq=None, regex=None,
               bounds: DataFrame | None = None) -> DataFrame:
    s = where_labels(df, metric, eq, regex).groupBy("ts").agg(F.sum("value").alias("value"))
    return on_grid(s, bounds)


def metric_mean(df: DataFrame, metric: str, eq=None, regex=None,
                bounds: DataFrame | None = None) -> DataFrame:
    s = where_labels(df, metric, eq, regex).groupBy("ts").agg(
        F.try_divide(F.sum("value"), F.count("value")).alias("value"))
    return on_grid(s, bounds)


def _on_job_grid(keys: DataFrame, bounds: DataFrame) -> DataFrame:
    """``keys`` with ``start`` and ``end`` of the one row of ``bounds`` (scalar subqueries, no join)."""
    return keys.withColumn("start", bounds.select("start").scalar()).withColumn("end", bounds.select("end").scalar())


def series_by_label(df: DataFrame, label: str, metric: str | None = None,
                    bounds: DataFrame | None = None) -> DataFrame:
    """One series per value of ``label`` (of ``metric``) on the job grid (bounds of all of
    ``df`` unless given) -- the grouped range query.

    Series that share the label's value share its one series: a point takes the
    value of the last one, in the order of ``at`` if the samples have it (see
    :func:`explode_matrix`), else of the label sets.  A selected sample without
    that label is an error.
    """
    raw = F.col("labels")[label]
    key = F.when(F.coalesce(raw, F.lit("")) == "", F.raise_error(F.lit(f"a selected sample has no label {label}")).cast("string")).otherwise(raw)
    order = F.col("at") if "at" in df.columns else series_key()
    picked = where_labels(df, metric).select(key.alias("__s"), "ts", "value", order.alias("__at"))
    points = picked.groupBy("__s", "ts").agg(F.max_by("value", "__at").alias("value"))
    kb = _on_job_grid(picked.select("__s").distinct(), job_bounds(df) if bounds is None else bounds)
    g = grid_from_bounds(kb, by=["__s"])
    return g.join(points, on=["__s", "ts"], how="left").select(F.col("__s").alias(label), "ts", "value")


def first_series(df: DataFrame, bounds: DataFrame | None = None, span: int = SPAN_POINTS) -> DataFrame:
    """The single-series range query on the job grid, asked for in spans of ``span`` seconds from the start.

    Two spans in a row share the second at their edge.  Each span gives the
    points of its first series (in the order of the label sets); where two spans
    give a second, the later one stands, with a null as well.
    """
    bounds = job_bounds(df) if bounds is None else bounds
    off = F.col("ts") - F.col("__start")
    part = F.floor(off / F.lit(span)).cast("long")
    parts = F.when((off > 0) & (off % span == 0), F.array(part - 1, part)).otherwise(F.array(part))
    placed = (df.withColumn("__start", bounds.select("start").scalar())
              .select("ts", "value", F.struct(F.col("metric"), series_key()).alias("__key"), F.explode(parts).alias("__part")))
    first = placed.groupBy("__part").agg(F.min("__key").alias("__key"))   # a row per span
    points = placed.join(first, ["__part", "__key"]).groupBy("ts").agg(F.max_by("value", "__part").alias("value"))
    return on_grid(points, bounds)


def total_by_ts(df: DataFrame, metric: str, bounds: DataFrame | None = None) -> DataFrame:
    """Sum over all label sets (pods) of ``metric`` on the job grid."""
    return metric_sum(df, metric, bounds=bounds)


def trailing_max_steps(df: DataFrame, by: Sequence[str], seconds: int = 3600, left_open: bool = True) -> DataFrame:
    """``(*by, first, last, value)``: the seconds ``first`` to ``last`` over which the max of the samples of
    ``df(*by, ts, value)`` in ``(ts - seconds, ts]`` is ``value``; seconds without a sample in reach are in none.

    Time is cut into blocks as long as the frame, so the frame of a second is the
    head of its own block (a running max forwards) and the tail of the block
    before (a running max backwards).  Both change at samples only: every sample
    marks where its head begins in its block and its tail in the next one, and
    the marks of a block, in order, make its steps.  All windows are over the
    samples of one (series, block), so a row's work does not depend on the grid
    and a long series is many groups.
    """
    by = list(by)
    frame = seconds if left_open else seconds + 1
    block = F.floor(F.col("ts") / F.lit(frame)).cast("long")
    rows = df.where("value IS NOT NULL").select(*by, "ts", F.col("value").cast("double").alias("value"), block.alias("__blk"))
    forth = Window.partitionBy(*by, "__blk").orderBy(F.col("ts").asc())
    back = Window.partitionBy(*by, "__blk").orderBy(F.col("ts").desc())
    so_far = (Window.unboundedPreceding, 0)
    runs = rows.select(*by, "ts", "__blk", F.max("value").over(forth.rowsBetween(*so_far)).alias("__head"),
                       F.max("value").over(back.rowsBetween(*so_far)).alias("__tail"),
                       F.lag("ts").over(forth).alias("__before"), F.lead("ts").over(forth).isNull().alias("__ends"))
    ts, then = F.col("ts"), F.col("__blk") + 1
    tail = "struct<v:double>"   # not null with a null in it: from here on the block before is out of reach
    mark = lambda blk, at, head, of: F.struct(blk.alias("__blk"), at.alias("first"), head.alias("head"), of.cast(tail).alias("tail"))
    begins = F.coalesce(F.col("__before") + frame, then * frame)
    marks = F.array(mark(F.col("__blk"), ts, F.col("__head"), F.lit(None)),
                    F.when(begins < ts + frame, mark(then, begins, F.lit(None).cast("double"), F.struct(F.col("__tail").alias("v")))),
                    F.when(F.col("__ends"), mark(then, ts + frame, F.lit(None).cast("double"), F.struct(F.lit(None).cast("double").alias("v")))))
    marked = runs.select(*by, F.explode(F.filter(marks, lambda m: m.isNotNull())).alias("m")).select(*by, "m.*")
    order = Window.partitionBy(*by, "__blk").orderBy("first")
    end = F.coalesce(F.lead("first").over(order), (F.col("__blk") + 1) * frame) - 1
    # peers of one second see each other's head and tail; all but the last of them get an empty step
    steps = marked.select(*by, "first", end.alias("last"), F.greatest(
        F.last("head", ignorenulls=True).over(order), F.last("tail", ignorenulls=True).over(order)["v"]).alias("value"))
    return steps.where("first <= last AND value IS NOT NULL")


def _each_second(steps: DataFrame, *keys: str) -> DataFrame:
    """``steps`` with ``start`` and ``end`` of their grid -> ``(*keys, ts, value)`` within it."""
    inside = steps.select(*keys, F.greatest("first", "start").alias("first"), F.least("last", "end").alias("last"), "value")
    return inside.where("first <= last").select(*keys, F.explode(F.sequence("first", "last")).alias("ts"), "value")


def _seconds_only(bounds: DataFrame) -> DataFrame:
    """``bounds``, which fail the query if they are not in 10-digit seconds."""
    end = F.when(step_of(F.col("start"), F.col("end")) == 1, F.col("end")).otherwise(
        F.raise_error(F.lit("metric grid needs 10-digit seconds")).cast("long"))
    return bounds.withColumn("end", end)


def trailing_max(df: DataFrame, by: Sequence[str], bounds: DataFrame, seconds: int = 3600, left_open: bool = True) -> DataFrame:
    """``(*by, ts, value)``: per series, the max over the samples in ``(ts - seconds, ts]`` at each second
    of its grid; ``df`` is ``(*by, ts, value)`` and ``bounds`` ``(*by, start, end)``."""
    by = list(by)
    bounds = _seconds_only(bounds)
    dense = _each_second(trailing_max_steps(df, by, seconds, left_open).join(bounds, by), *by)
    return grid_from_bounds(bounds, by=by).join(dense, [*by, "ts"], "left").select(*by, "ts", "value")


def trailing_max_sum(df: DataFrame, metric: str, seconds: int = 3600, left_open: bool = True,
                     bounds: DataFrame | None = None) -> DataFrame:
    """``sum(max_over_time(metric[seconds]))`` on the job grid (1-second steps): the trailing max of every
    series -- every label set -- and their sum per second."""
    picked = where_labels(df, metric)
    per_ts = picked.select(series_key().alias("__s"), "ts", nan_to_null("value").alias("value")).groupBy("__s", "ts").agg(F.max("value").alias("value"))
    bounds = _seconds_only(job_bounds(df) if bounds is None else bounds)
    steps = _on_job_grid(trailing_max_steps(per_ts, ["__s"], seconds, left_open), bounds)
    sums = _each_second(steps).groupBy("ts").agg(F.sum("value").alias("value"))
    any_series = _on_job_grid(picked.select("metric").limit(1), bounds)   # without a series there is no grid
    return grid_from_bounds(any_series).join(sums, "ts", "left").select("ts", "value")


def _delay(source: Column, sink: Column, workers: Column, limit: float) -> Column:
    d = F.abs(F.try_divide(F.try_divide(source - sink, workers), F.lit(1000.0)))
    return F.when(d < limit, d)


def progress_delay(df: DataFrame, source: Term, sink: Term, workers: Term,
                   limit: float = 1500.0, bounds: DataFrame | None = None) -> DataFrame:
    """``abs((sum(source>0) - sum(sink>0)) / avg(workers) / 1000)``, kept when ``< limit``.

    Each term is a metric name or a predicate (:func:`selects`): the usual case
    is one metric under two values of a label.
    """
    above = lambda term: F.sum(F.when(F.col("value") > 0, _picked(term)))
    s = df.groupBy("ts").agg(_delay(above(source), above(sink), F.avg(_picked(workers)), limit).alias("value"))
    return on_grid(s, bounds)


def state_usage(df: DataFrame, usage: Term, pinned: Term, capacity: Term, workers: Term | None,
                by: Sequence[str] = (), bounds: DataFrame | None = None) -> DataFrame:
    """``(sum(usage) + sum(pinned)) / (max(capacity) * avg(workers))``; terms as in :func:`progress_delay`.

    With ``by`` label names (e.g. namespace, pod) the sums and max are taken per
    label set and the worker factor is left out (the per-pod form).
    """
    by = list(by)
    keys = [F.col("labels")[k].alias(k) for k in by]
    num = F.sum(_picked(usage)) + F.sum(_picked(pinned))
    cap = F.max(_picked(capacity))
    den = cap if by or workers is None else cap * F.avg(_picked(workers))
    out = df.groupBy(*keys, "ts").agg(F.try_divide(num, den).alias("value"))
    if by:
        return out.select(*by, "ts", "value")
    return on_grid(out, bounds)


def uptime_seconds(df: DataFrame, by: Sequence[str] = (), bounds: DataFrame | None = None) -> DataFrame:
    """Per ``by`` group of ``(*by, ts, value)``: the last point of the grid, ms -> whole seconds (truncated).

    A group without a value at the end of the grid (``bounds``, else that of all
    of ``df``) has 0.  Of several series of a group the first counts, in the
    order of ``labels`` if there are any.
    """
    by = list(by)
    end = (job_bounds(df) if bounds is None else bounds).select("end").scalar()
    order = series_key() if "labels" in df.columns else F.lit(0)
    at_end = F.when(F.col("ts") == F.col("__end"), F.col("value"))
    own = df.withColumn("__end", end).groupBy(*by).agg(F.min_by(at_end, F.struct(order, -F.col("ts"))).alias("__v"))
    secs = F.coalesce(F.expr("CAST(__v AS BIGINT) div 1000"), F.lit(0).cast("long"))
    return own.select(*by, secs.alias("uptime_s"))


# --- export ---------------------------------------------------------------------------

EXPORTED = ("cpuLoad", "memUsed", "numWorkers", "numRestarts", "delay", "stateUsage")


def export_series(samples: DataFrame, job: str, terms: Mapping[str, Term], scratch: str,
                  restarts_seconds: int = 3600, limit: float = 1500.0) -> DataFrame:
    """``(job_id, name, ts, value)``: the six series of every job on the job's own grid.

    ``job`` is the label that tells jobs apart; ``terms`` picks the samples of
    ``cpu``, ``memory``, ``workers``, ``restarts``, ``source``, ``sink``,
    ``usage``, ``pinned`` and ``capacity``.  One scan of the samples gives a
    table of partial sums per (job, series, second), written to ``scratch``; all
    series, and the jobs' bounds, come from that table.
    """
    part = {f"s_{n}": F.sum(_picked(terms[n])) for n in ("cpu", "memory", "workers", "usage", "pinned")}
    part |= {f"s_{n}": F.sum(F.when(F.col("value") > 0, _picked(terms[n]))) for n in ("source", "sink")}
    part |= {"n_workers": F.count(_picked(terms["workers"])), "m_capacity": F.max(_picked(terms["capacity"])),
             "m_restarts": F.max(nan_to_null(_picked(terms["restarts"])))}
    table = samples.groupBy(F.col("labels")[job].alias("job_id"), series_key().alias("series"), "ts").agg(
        *[c.alias(n) for n, c in part.items()])
    table.write.parquet(scratch)
    table = samples.sparkSession.read.schema(table.schema).parquet(scratch)
    bounds = table.groupBy("job_id").agg(F.min("ts").alias("start"), F.max("ts").alias("end"))
    whole = table.groupBy("job_id", "ts").agg(
        *[F.sum(n).alias(n) for n in part if n[0] in "sn"], F.max("m_capacity").alias("m_capacity"))
    workers = F.try_divide(F.col("s_workers"), F.col("n_workers"))
    values = {"cpuLoad": F.col("s_cpu"), "memUsed": F.col("s_memory"), "numWorkers": F.col("s_workers"),
              "delay": _delay(F.col("s_source"), F.col("s_sink"), workers, limit),
              "stateUsage": F.try_divide(F.col("s_usage") + F.col("s_pinned"), F.col("m_capacity") * workers)}
    restarts = table.select("job_id", "series", "ts", F.col("m_restarts").alias("value")).where("value IS NOT NULL")
    steps = trailing_max_steps(restarts, ["job_id", "series"], restarts_seconds).join(_seconds_only(bounds), "job_id")
    tops = _each_second(steps, "job_id").groupBy("job_id", "ts").agg(F.sum("value").alias("numRestarts"))
    grid = grid_from_bounds(bounds, by=["job_id"])
    wide = (grid.join(whole.select("job_id", "ts", *[c.alias(n) for n, c in values.items()]), ["job_id", "ts"], "left")
            .join(tops, ["job_id", "ts"], "left"))
    return wide.unpivot(["job_id", "ts"], list(EXPORTED), "name", "value").select("job_id", "name", "ts", "value")


def export_metrics(named: DataFrame, path: str, sep: str = "|") -> None:
    """Write ``(job_id, name, ts, value)`` as ``<path>/job_id=<j>/name=<n>/`` CSV files.

    Rows are range-partitioned by job, series and time: a long series is several
    files in time order, and short ones share a task.
    """
    (named.select("job_id", "name", F.col("ts").alias("timestamp"), "value")
        .orderBy("job_id", "name", "timestamp")
        .write.mode("append").partitionBy("job_id", "name")
        .option("sep", sep).option("header", True).option("nullValue", "null").csv(path))


def read_exported(spark, path: str, sep: str = "|") -> DataFrame:
    return (spark.read.schema("timestamp LONG, value DOUBLE, job_id STRING, name STRING")
            .option("sep", sep).option("header", True).option("nullValue", "null").csv(path)
            .select("job_id", "name", F.col("timestamp").alias("ts"), "value"))
