"""Experiment profiles: one summary row per (experiment, job), and the profile table.

The table has 16 NOT NULL columns and lies in one folder of plain Parquet.  An
insert is a folder of its own, named by its run: the same run again replaces it.
A delete is an anti-join written as the table's next version, which counts once
it is complete; ids stay on the executors, and a call is one step.  Any process
that knows the folder can open it; one process writes at a time.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROFILE_SCHEMA = T.StructType([
    T.StructField("expId", T.IntegerType(), False),
    T.StructField("scaleOut", T.IntegerType(), False),
    T.StructField("jobId", T.StringType(), False),
    T.StructField("workload", T.LongType(), False),
    T.StructField("avgLat", T.DoubleType(), False),
    T.StructField("avgThr", T.DoubleType(), False),
    T.StructField("isBckPres", T.IntegerType(), False),
    T.StructField("perBckPres", T.DoubleType(), False),
    T.StructField("avgConsLag", T.DoubleType(), False),
    T.StructField("avgChkDur", T.DoubleType(), False),
    T.StructField("cpuAvg", T.DoubleType(), False),
    T.StructField("memAvg", T.DoubleType(), False),
    T.StructField("cpuTotal", T.DoubleType(), False),
    T.StructField("memTotal", T.DoubleType(), False),
    T.StructField("startTs", T.LongType(), False),
    T.StructField("stopTs", T.LongType(), False),
])
PROFILE_COLUMNS = [f.name for f in PROFILE_SCHEMA.fields]
REAL_COLUMNS = [f.name for f in PROFILE_SCHEMA.fields if isinstance(f.dataType, T.DoubleType)]

# which metric plays which role when profiles are built from samples
DEFAULT_ROLES = {
    "latency": "latency",
    "throughput": "throughput",
    "backpressure": "backpressure",
    "consumer_lag": "consumer_lag",
    "checkpoint_duration": "checkpoint_duration",
    "cpu": "cpu",
    "memory": "memory",
}


def conform(df: DataFrame) -> DataFrame:
    """Cast to the table's types; columns that ``df`` lacks are null."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                       for f in PROFILE_SCHEMA.fields])


def complete(df: DataFrame) -> DataFrame:
    """``df`` in the table's types; a null in any column fails the query (all columns are NOT NULL)."""
    checked = [F.when(F.col(c).isNull(), F.raise_error(F.lit(f"a profile needs {c}")).cast(PROFILE_SCHEMA[c].dataType))
               .otherwise(F.col(c)).alias(c) for c in PROFILE_COLUMNS]
    return conform(df).select(*checked)


def build_profiles(samples: DataFrame, exp_id: Column, job_id: Column,
                   roles: Mapping[str, str] | None = None,
                   backpressure_above: float = 0.0) -> DataFrame:
    """Summarise samples ``(metric, labels, ts, value)`` per (experiment, job).

    scaleOut = number of label sets (pods) seen for the job, workload = total
    throughput (whole), isBckPres / perBckPres = any / share of back-pressure
    samples above ``backpressure_above``.  What has no sample is null; infinite
    samples make infinite means.
    """
    r = dict(DEFAULT_ROLES)
    r.update(roles or {})

    def of(role: str) -> Column:
        return F.when(F.col("metric") == r[role], F.col("value"))

    def mean(role: str) -> Column:
        return F.avg(of(role))

    bp = of("backpressure")
    g = samples.groupBy(exp_id.alias("expId"), job_id.alias("jobId")).agg(
        F.count_distinct(F.col("labels")["pod"]).alias("scaleOut"),
        F.floor(F.round(F.sum(of("throughput")), 6)).alias("workload"),
        mean("latency").alias("avgLat"),
        mean("throughput").alias("avgThr"),
        F.max(F.when(bp > backpressure_above, 1).otherwise(0)).alias("isBckPres"),
        F.try_divide(F.count(F.when(bp > backpressure_above, 1)), F.count(bp)).alias("perBckPres"),
        mean("consumer_lag").alias("avgConsLag"),
        mean("checkpoint_duration").alias("avgChkDur"),
        mean("cpu").alias("cpuAvg"),
        mean("memory").alias("memAvg"),
        F.sum(of("cpu")).alias("cpuTotal"),
        F.sum(of("memory")).alias("memTotal"),
        F.min("ts").alias("startTs"),
        F.max("ts").alias("stopTs"),
    )
    return conform(g)


def _ids(ids: Sequence[int] | DataFrame | int) -> DataFrame | list[int]:
    if isinstance(ids, DataFrame):
        return ids.select(F.col(ids.columns[0]).cast("int").alias("expId")).distinct()
    if isinstance(ids, int):
        return [ids]
    return [int(i) for i in ids]


def profiles_select(table: DataFrame, exp_ids) -> DataFrame:
    """``WHERE expId IN (...) ORDER BY scaleOut, workload``; ids may be a DataFrame."""
    ids = _ids(exp_ids)
    if isinstance(ids, DataFrame):
        sel = table.join(ids, on="expId", how="left_semi")
    else:
        sel = table.where(F.col("expId").isin(ids))
    return sel.select(*PROFILE_COLUMNS).orderBy(F.col("scaleOut").asc(), F.col("workload").asc())


class ProfileTable:
    """The profile table in folder ``root``; opening it again finds the rows."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._path = lambda *parts: path("/".join([self.root, *parts]))
        self._fs = self._path().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _version(self) -> int:
        """The number of the newest complete version; version 0 is made of inserts alone."""
        if not self._fs.exists(self._path()):
            return 0
        names = [str(s.getPath().getName()) for s in self._fs.listStatus(self._path())]
        numbers = sorted((int(n.removeprefix("version=")) for n in names if n.startswith("version=")), reverse=True)
        return next((n for n in numbers if n and self._fs.exists(self._path(f"version={n}", "_SUCCESS"))), 0)

    def _rows(self) -> DataFrame:
        """The rows with their ``run``."""
        schema = T.StructType([*PROFILE_SCHEMA.fields, T.StructField("run", T.StringType())])
        where = f"version={self._version()}"
        if not self._fs.exists(self._path(where)):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{where}")

    def create(self, exp_id: int | None = None) -> ProfileTable:
        """Make the folder if there is none; with ``exp_id``, remove that experiment's rows."""
        self._fs.mkdirs(self._path())
        if exp_id is not None:
            self.delete([exp_id])
        return self

    def read(self) -> DataFrame:
        return self._rows().select(*PROFILE_COLUMNS)

    def insert(self, rows: DataFrame, run: str | None = None) -> None:
        """Add ``rows`` as ``run`` (a name of its own, unless given), in place of what that run has added before."""
        run = uuid.uuid4().hex if run is None else run
        if not re.fullmatch(r"[A-Za-z0-9._-]+", run):
            raise ValueError(f"a run's name must do for a folder: {run!r}")
        complete(rows).write.mode("overwrite").parquet(f"{self.root}/version={self._version()}/run={run}")

    def _rewrite(self, left: DataFrame) -> None:
        old = self._version()
        left.repartitionByRange("run", "expId").write.mode("overwrite").partitionBy("run").parquet(f"{self.root}/version={old + 1}")
        self._fs.delete(self._path(f"version={old}"), True)

    def delete(self, exp_ids) -> None:
        """Drop whole experiments; ids may be a DataFrame."""
        ids, rows = _ids(exp_ids), self._rows()
        if isinstance(ids, DataFrame):
            self._rewrite(rows.join(ids, "expId", "left_anti"))
        else:
            self._rewrite(rows.where(~F.col("expId").isin(ids)))

    def delete_jobs(self, pairs: DataFrame) -> None:
        """Drop the rows of each ``(expId, jobId)`` of ``pairs``."""
        gone = pairs.select(F.col("expId").cast("int").alias("expId"), "jobId").distinct()
        self._rewrite(self._rows().join(gone, ["expId", "jobId"], "left_anti"))

    def select(self, exp_ids) -> DataFrame:
        return profiles_select(self.read(), exp_ids)
