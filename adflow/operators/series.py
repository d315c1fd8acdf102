"""Null-aware time series as long tables ``(series_id, ts, value)``.

A series lives on a grid: one point per step between its first and last
timestamp, value null where nothing was observed.  The step follows from the
timestamp width: 10 digits = seconds (step 1), 13 digits = milliseconds (step
1000); any other or mixed width is an error.

Everything is a distributed DataFrame operation: grids are generated per
series from its bounds (in chunks, never one huge array), merges are one
``groupBy(ts)`` sum (SQL ``sum`` is exactly the null rule: all null -> null),
and ordered scans use the block scheme of :mod:`adflow.operators.scan`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from adflow.operators.scan import row_rank

GRID_CHUNK = 1 << 16  # grid points generated per row before the second explode


def _digits(c: Column) -> Column:
    return F.when(c > 0, F.floor(F.log10(c)).cast("int") + 1).otherwise(F.lit(0))


def step_of(start: Column, end: Column) -> Column:
    """1 for 10-digit bounds, 1000 for 13-digit bounds, error otherwise."""
    ds, de = _digits(start), _digits(end)
    return (F.when((ds == 10) & (de == 10), F.lit(1).cast("long"))
            .when((ds == 13) & (de == 13), F.lit(1000).cast("long"))
            .otherwise(F.raise_error(F.format_string(
                "bounds %s and %s are neither both 10 nor both 13 digits wide", start.cast("string"), end.cast("string")))
                .cast("long")))


def python_step(start: int, end: int) -> int:
    ds, de = len(str(start)), len(str(end))
    if ds == 10 and de == 10:
        return 1
    if ds == 13 and de == 13:
        return 1000
    raise ValueError(f"bounds {start} and {end} are neither both 10 nor both 13 digits wide")


def grid(spark: SparkSession, start: int, end: int) -> DataFrame:
    """All grid points ``[start, end]`` as ``ts`` (a distributed range)."""
    step = python_step(start, end)
    return spark.range(start, end + 1, step).select(F.col("id").alias("ts"))


def grid_from_bounds(bounds: DataFrame, by: Sequence[str] = (), start: str = "start",
                     end: str = "end", chunk: int = GRID_CHUNK,
                     step: int | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """Grid points of every row of ``bounds`` -> ``(*by, *carry, ts)``.

    Points are produced in chunks of ``chunk``: one explode over chunk numbers,
    which are then dealt out over all partitions, and one over the points of a
    chunk.  So no row holds more than ``chunk`` values, and one long series is
    made by many tasks.  ``step`` overrides the timestamp-width rule (e.g. 1 for
    plain indexes); ``carry`` names columns of ``bounds`` that the points keep.
    """
    by = [*by, *carry]
    n = int(bounds.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    step_col = (F.lit(step).cast("long") if step is not None
                else step_of(F.col("__gs"), F.col("__ge")))
    b = bounds.select(*by, F.col(start).alias("__gs"), F.col(end).alias("__ge")).withColumn(
        "__gstep", step_col)
    span = F.lit(chunk) * F.col("__gstep")
    chunks = b.select(*by, "__gs", "__ge", "__gstep", F.explode(F.sequence(
        F.lit(0).cast("long"), F.floor((F.col("__ge") - F.col("__gs")) / span).cast("long")))
        .alias("__gc")).repartition(n, *by, "__gc")
    lo = F.col("__gs") + F.col("__gc") * span
    hi = F.least(F.col("__ge"), lo + span - F.col("__gstep"))
    return chunks.select(*by, F.explode(F.sequence(lo, hi, F.col("__gstep"))).alias("ts"))


def bounds_of(df: DataFrame, by: Sequence[str] = ("series_id",)) -> DataFrame:
    return df.groupBy(*by).agg(F.min("ts").alias("start"), F.max("ts").alias("end"))


def densify(df: DataFrame, by: Sequence[str] = ("series_id",),
            bounds: DataFrame | None = None, keep_bounds: bool = False) -> DataFrame:
    """Lay each series on its grid (its own first..last, or the given ``bounds``).

    Observations off the grid vanish; grid points without one are null.  With
    ``keep_bounds`` each point keeps ``start`` and ``end`` of its grid (see :func:`resample`).
    """
    by = list(by)
    if bounds is None:
        bounds = bounds_of(df, by)
    kept = ["start", "end"] if keep_bounds else []
    g = grid_from_bounds(bounds.withColumns({f"__{c}": F.col(c) for c in kept}), by, carry=[f"__{c}" for c in kept])
    vals = df.select(*by, "ts", "value")
    return g.join(vals, on=[*by, "ts"], how="left").select(
        *by, "ts", "value", *[F.col(f"__{c}").alias(c) for c in kept])


def _global_bounds(df: DataFrame) -> DataFrame:
    return df.agg(F.min("ts").alias("start"), F.max("ts").alias("end"))


def merge(*series: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Unaligned merge of two or more series: one grid over min(first)..max(last),
    null-aware sum where they meet, the single value where only one has a point.

    Pass several DataFrames ``(ts, value)``, or one long DataFrame with a
    ``series_id`` column holding all the series (``by`` groups independent merges).
    """
    by = list(by)
    if len(series) == 1:
        long_df = series[0]
        check = F.min("series_id") != F.max("series_id")
    else:
        long_df = series[0].select(*by, "ts", "value")
        for s in series[1:]:
            long_df = long_df.unionByName(s.select(*by, "ts", "value"))
        check = None
    summed = long_df.groupBy(*by, "ts").agg(F.sum("value").alias("value"))
    if check is None:
        bounds = long_df.groupBy(*by).agg(F.min("ts").alias("start"), F.max("ts").alias("end"))
    else:
        bounds = long_df.groupBy(*by).agg(
            F.min("ts").alias("start"),
            F.when(check, F.max("ts")).otherwise(F.raise_error(
                F.lit("merge needs at least two series")).cast("long")).alias("end"))
    return densify(summed, by, bounds)


def merge_aligned(a: DataFrame, b: DataFrame) -> DataFrame:
    """Merge two series that share first ts, last ts and size; the query fails otherwise.

    One tagged union feeds the sums and the check, which is a scalar subquery of the same plan.
    """
    u = a.select("ts", "value", F.lit(0).alias("__side")).unionByName(b.select("ts", "value", F.lit(1).alias("__side")))
    of = lambda agg, side: agg(F.when(F.col("__side") == side, F.col("ts")))
    shape = lambda side: F.struct(of(F.min, side), of(F.max, side), of(F.count, side))
    same = u.agg(F.when(shape(0).eqNullSafe(shape(1)), F.lit(True)).otherwise(F.raise_error(F.concat(
        F.lit("series of different shape: "), shape(0).cast("string"), F.lit(" and "), shape(1).cast("string")))
        .cast("boolean")).alias("same")).scalar()
    return u.groupBy("ts").agg(F.sum("value").alias("value")).where(same)


def _masked(value: str = "value") -> Column:
    return F.when(F.isnan(value), F.lit(None).cast("double")).otherwise(F.col(value))


def stats(df: DataFrame, by: Sequence[str] = ("series_id",), strict: bool = False) -> DataFrame:
    """avg (NaN when no value), min, max, sum (0 when no value), size (null points count).

    Default min/max start from 0, as the reference does (min never above 0, max
    never below 0); ``strict=True`` gives the true extremes (null when none).
    NaN samples are ignored by min/max (Java's ``<`` is false for NaN).
    """
    mn, mx = F.min(_masked()), F.max(_masked())
    if not strict:
        mn, mx = F.least(F.lit(0.0), mn), F.greatest(F.lit(0.0), mx)
    return df.groupBy(*by).agg(
        F.coalesce(F.avg("value"), F.lit(float("nan"))).alias("avg"),
        mn.alias("min"),
        mx.alias("max"),
        F.coalesce(F.sum("value"), F.lit(0.0)).alias("sum"),
        F.count(F.lit(1)).alias("size"),
    )


def first_last(df: DataFrame, by: Sequence[str] = ("series_id",)) -> DataFrame:
    return df.groupBy(*by).agg(
        F.min("ts").alias("first_ts"),
        F.min_by("value", "ts").alias("first_value"),
        F.max("ts").alias("last_ts"),
        F.max_by("value", "ts").alias("last_value"),
    )


def _anchor_table(df: DataFrame, by: list[str], anchor: int | None) -> DataFrame:
    if anchor is None:
        a = df.groupBy(*by).agg(F.max("ts").alias("__anchor"), F.min("ts").alias("__first"))
    else:
        found = F.max(F.when(F.col("ts") == F.lit(anchor), F.lit(1)))
        a = df.groupBy(*by).agg(
            F.when(found.isNotNull(), F.lit(anchor).cast("long")).otherwise(F.raise_error(
                F.lit(f"the series has no point at {anchor}")).cast("long")).alias("__anchor"),
            F.min("ts").alias("__first"))
    return a


def resample(df: DataFrame, rate: int, anchor: int | None = None, limit: int | None = None,
             by: Sequence[str] = ("series_id",)) -> DataFrame:
    """Keep every ``rate``-th grid point walking back from ``anchor`` (default: the
    last point), at most ``limit`` points; ``df`` must be on its grid (see
    :func:`densify`).  Pure arithmetic on the grid position: no sort, and no join
    when the points carry ``start`` and ``end`` (``densify(keep_bounds=True)``)."""
    if rate <= 0:
        raise ValueError("rate must be positive")
    by = list(by)
    if {"start", "end"} <= set(df.columns):
        anchored = F.col("end") if anchor is None else F.when(
            F.lit(anchor).between(F.col("start"), F.col("end")), F.lit(anchor).cast("long")).otherwise(
            F.raise_error(F.lit(f"the series has no point at {anchor}")).cast("long"))
        j = df.withColumn("__anchor", anchored).withColumn("__first", F.col("start"))
    else:
        j = df.join(_anchor_table(df, by, anchor), on=by, how="inner")
    step = step_of(F.col("__first"), F.col("__anchor"))
    pos = ((F.col("__anchor") - F.col("ts")) / step).cast("long")
    keep = (F.col("ts") <= F.col("__anchor")) & (F.pmod(pos, F.lit(rate)) == 0)
    if limit is not None:
        keep = keep & (F.floor(pos / F.lit(rate)) < F.lit(limit))
    return j.where(keep).select(*by, "ts", "value")


def resample_irregular(df: DataFrame, rate: int, anchor: int | None = None,
                       limit: int | None = None, by: Sequence[str] = ("series_id",),
                       block: int = 1 << 20) -> DataFrame:
    """As :func:`resample`, counting positions over the points present (no grid)."""
    if rate <= 0:
        raise ValueError("rate must be positive")
    by = list(by)
    upto = df if anchor is None else df.where(F.col("ts") <= F.lit(anchor))
    ranked = row_rank(upto, by, "ts", block, descending=True, out="__pos", top=anchor)
    keep = F.pmod(F.col("__pos"), F.lit(rate)) == 0
    if limit is not None:
        keep = keep & (F.floor(F.col("__pos") / F.lit(rate)) < F.lit(limit))
    return ranked.where(keep).select(*by, "ts", "value")


def lookup(df: DataFrame, keys: DataFrame, by: Sequence[str] = (),
           missing: str = "null") -> DataFrame:
    """Value at each requested ``(by, ts)``; missing -> null, or an error with ``missing='raise'``."""
    by = list(by)
    j = keys.select(*by, "ts").join(
        df.select(*by, "ts", "value", F.lit(True).alias("__hit")), on=[*by, "ts"], how="left")
    value = F.col("value")
    if missing == "raise":
        value = F.when(F.col("__hit").isNull(), F.raise_error(F.format_string(
            "no point at %s", F.col("ts").cast("string")))
            .cast("double")).otherwise(value)
    return j.select(*by, "ts", value.alias("value"))


def upsert(df: DataFrame, updates: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Set the value at each updated timestamp (a null update sets null); an update
    at a timestamp the series does not have is an error."""
    by = list(by)
    base = df.select(*by, "ts", F.col("value").alias("__old"), F.lit(True).alias("__in_base"))
    upd = updates.select(*by, "ts", F.col("value").alias("__new"), F.lit(True).alias("__upd"))
    j = base.join(upd, on=[*by, "ts"], how="full_outer")
    value = (F.when(F.col("__in_base").isNull(), F.raise_error(F.format_string(
        "no point at %s", F.col("ts").cast("string"))).cast("double"))
        .when(F.col("__upd").isNotNull(), F.col("__new"))
        .otherwise(F.col("__old")))
    return j.select(*by, "ts", value.alias("value"))


def _chunked(df: DataFrame, by: list[str], chunk_span: int) -> DataFrame:
    """One row per ``chunk_span`` of time (in the unit of ``ts``) that holds points: its number within
    the series, its start, its points in order, and the number of points of the whole series."""
    start = (F.floor(F.col("ts") / F.lit(chunk_span)) * F.lit(chunk_span)).cast("long")
    chunks = df.groupBy(*by, start.alias("chunk_start")).agg(
        F.array_sort(F.collect_list(F.struct("ts", "value"))).alias("__obs"))
    series = Window.partitionBy(*by)   # over chunks, not points
    return chunks.select(
        *by, (F.row_number().over(series.orderBy("chunk_start")) - 1).cast("long").alias("chunk"), "chunk_start", "__obs",
        F.sum(F.size("__obs")).over(series).cast("long").alias("series_count"))


def values(df: DataFrame, chunk_span: int, by: Sequence[str] = ("series_id",)) -> DataFrame:
    """Values in time order as ``double`` arrays: ``(*by, chunk, chunk_start, series_count, values)``.

    ``chunk_span`` bounds a row to that much time; one span over the whole
    series gives one array.  A null value is an error.
    """
    by = list(by)
    c = _chunked(df, by, chunk_span)
    vals = F.transform("__obs", lambda o: F.when(o["value"].isNull(), F.raise_error(
        F.lit("null value in series")).cast("double")).otherwise(o["value"]))
    return c.select(*by, "chunk", "chunk_start", "series_count", vals.alias("values"))


def to_json_text(df: DataFrame, chunk_span: int, by: Sequence[str] = ("series_id",)) -> DataFrame:
    """The parts of ``{"observations":[{"timestamp":t,"value":v}, ...],"count":n}``.

    Rows are ``(*by, chunk, chunk_start, series_count, json)``; the texts of a
    series in the order of ``chunk`` make its one document (the first part opens
    it, the last one closes it), so ``count`` is that of the whole series.
    """
    by = list(by)
    c = _chunked(df, by, chunk_span)
    obs = F.transform("__obs", lambda o: F.format_string(
        '{"timestamp":%s,"value":%s}', o["ts"].cast("string"),
        F.coalesce(o["value"].cast("string"), F.lit("null"))))
    last = F.col("chunk") == F.max("chunk").over(Window.partitionBy(*by))
    text = F.concat(F.when(F.col("chunk") == 0, F.lit('{"observations":[')).otherwise(F.lit(", ")), F.array_join(obs, ", "),
                    F.when(last, F.concat(F.lit('],"count":'), F.col("series_count").cast("string"), F.lit("}"))).otherwise(F.lit("")))
    return c.select(*by, "chunk", "chunk_start", "series_count", text.alias("json"))


def write_series_json(df: DataFrame, path: str, chunk_span: int, by: Sequence[str] = ("series_id",)) -> None:
    """One JSON document per series, as text files in a folder of its own (``<by>=<value>/``).

    The files of a folder, in order of their names, are the document, one chunk a
    line: rows are range-partitioned by series and chunk, so a long series is
    written by many tasks and no row is longer than a chunk.
    """
    by = list(by)
    parts = to_json_text(df, chunk_span, by)
    parts.orderBy(*by, "chunk").select(*by, F.col("json").alias("value")).write.mode("errorifexists").partitionBy(*by).text(path)


def read_series_json(spark: SparkSession, path: str, by: Sequence[str] = ("series_id",)) -> DataFrame:
    """The points ``(*by, ts, value)`` of :func:`write_series_json`, line by line, with the document's ``count`` where it is told."""
    by = list(by)
    lines = spark.read.schema("value string" + "".join(f", {c} string" for c in by)).text(path)
    inner = F.regexp_replace(F.regexp_replace("value", r'^(\{"observations":\[|, )', ""), r'\],"count":[0-9]+\}$', "")
    points = F.from_json(F.concat(F.lit("["), inner, F.lit("]")), "array<struct<timestamp:bigint,value:double>>")
    count = F.regexp_extract("value", r'\],"count":([0-9]+)\}$', 1).try_cast("bigint")
    return (lines.select(*by, F.explode_outer(points).alias("o"), count.alias("count"))
            .select(*by, F.col("o.timestamp").alias("ts"), F.col("o.value").alias("value"), "count"))


def sorted_series(df: DataFrame, by: Sequence[str] = ("series_id",)) -> DataFrame:
    return df.orderBy(*by, "ts")
