"""Series CSV files (``timestamp<sep>value`` lines) and the rate-curve CSV.

Series reader rules: the grid runs from the timestamp of the first line to
that of the last line (a bad one of these two is an error); lines that do not
parse or lie off the grid are skipped; a repeated timestamp takes the last
line; gaps are null.  The writer prints null as ``null`` and writes the header
with every file.  Every append goes to a folder of its own, ``batch=<number>``,
one above the highest so far, and files are read in that order: what is
appended later comes later, whatever its file is called.  With ``by``, each
series has a folder below its batch.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from adflow.functions.counting import counted
from adflow.operators.series import grid_from_bounds
from adflow.sources.lines import (drop_first_line_per_file, line_numbers, order_key,
                                  with_line_order)

SERIES_HEADER = ("timestamp", "value")


def _parts(sep: str):
    return F.split(F.col("value"), re.escape(sep))


def _next_batch(spark: SparkSession, path: str) -> int:
    """One above the highest batch folder below ``path`` (a listing on the driver, of folders only)."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return 0
    names = [str(s.getPath().getName()) for s in fs.listStatus(folder)]
    return 1 + max([int(n.removeprefix("batch=")) for n in names if re.fullmatch(r"batch=\d+", n)], default=-1)


def _lines(spark: SparkSession, path: str, by: list[str]) -> DataFrame:
    schema = "value string" + "".join(f", {c} string" for c in by)
    return spark.read.schema(schema).option("recursiveFileLookup", "false").text(path)


def read_series_csv(spark: SparkSession, path: str, sep: str = "|", header: bool = True,
                    by: Sequence[str] = (), skipped: Observation | None = None) -> DataFrame:
    """The series of the files below ``path``; ``skipped`` counts ``rows`` (lines) and those that are ``unparsed``."""
    by = list(by)
    lines = with_line_order(_lines(spark, path, by))
    if header:
        lines = drop_first_line_per_file(lines)
    parts = _parts(sep)
    parsed = lines.withColumn("__p", parts).select(
        *by, order_key().alias("__k"),
        F.expr("try_cast(try_element_at(__p, 1) AS BIGINT)").alias("ts"),
        F.expr("try_cast(try_element_at(__p, 2) AS DOUBLE)").alias("value"),
        (F.size("__p") >= 2).alias("__has_value"),
    )
    ends = parsed.groupBy(*by).agg(F.min_by("ts", "__k").alias("__first"), F.max_by("ts", "__k").alias("__last"))
    bounds = ends.select(
        *by,
        F.when(F.col("__first").isNull(), F.raise_error(F.lit("bad first line")).cast("long"))
        .otherwise(F.col("__first")).alias("start"),
        F.when(F.col("__last").isNull(), F.raise_error(F.lit("bad last line")).cast("long"))
        .otherwise(F.col("__last")).alias("end"),
    )
    parses = F.col("ts").isNotNull() & F.col("value").isNotNull() & F.col("__has_value")
    good = counted(parsed, skipped, unparsed=~parses).where(parses)
    last_wins = good.groupBy(*by, "ts").agg(F.max_by("value", "__k").alias("value"))
    g = grid_from_bounds(bounds, by)
    return g.join(last_wins, on=[*by, "ts"], how="left").select(*by, "ts", "value")


def write_series_csv(df: DataFrame, path: str, sep: str = "|", header: bool = True,
                     by: Sequence[str] = ()) -> None:
    """Append ``(*by, ts, value)`` rows in time order, as one batch (files ordered like the rows).

    Rows are range-partitioned by series and time, so a long series is many files.
    """
    by = list(by)
    out = df.select(*by, F.col("ts").alias(SERIES_HEADER[0]), F.col("value").alias(SERIES_HEADER[1]))
    batch = f"{path.rstrip('/')}/batch={_next_batch(df.sparkSession, path):09d}"
    (out.orderBy(*by, SERIES_HEADER[0]).write.mode("errorifexists").partitionBy(*by)
        .option("sep", sep).option("header", header).option("nullValue", "null")
        .csv(batch))


def read_series_csv_rows(spark: SparkSession, path: str, sep: str = "|",
                         header: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """Plain typed read of the CSV rows (no grid), for round trips."""
    by = list(by)
    schema = "ts LONG, value DOUBLE" + "".join(f", {c} string" for c in by)
    return (spark.read.schema(schema).option("sep", sep)
            .option("header", header).option("nullValue", "null").option("mode", "FAILFAST")
            .csv(path).select(*by, "ts", "value"))


def read_rate_curve(spark: SparkSession, path: str, sep: str = "|",
                    header: bool = True) -> DataFrame:
    """Rate curve ``(i, ts, value)``: ``i`` is the 0-based row in file order; any
    bad line fails the read."""
    df = (spark.read.schema("ts LONG, value INT").option("sep", sep).option("header", header)
          .option("mode", "FAILFAST").csv(path))
    df = line_numbers(with_line_order(df), out="i")
    return df.select("i", "ts", "value")


def write_rate_curve(df: DataFrame, path: str, sep: str = "|") -> None:
    (df.orderBy("i").select("ts", "value").write.mode("overwrite")
        .option("sep", sep).option("header", True).csv(path))
