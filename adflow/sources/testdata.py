"""Views over the shared test tables (``<sf_dir>/<name>.parquet``).

These map the generic tables onto the data model of the operators:

* ad events    <- ``events``: ad id = user id (``'x' || user_id`` where user_id % 7 = 3:
  ads that no customer has), type = event_type, event time = ``ts`` truncated to whole seconds (as the generator does), ``ts`` = its epoch ms.
* wire events  <- the ad events through the encoder, Kafka-shaped; ``error``
  events are malformed, in turn: their ``props`` text, a number for ``ts``, a
  blank before it, a number for ``id``.
* campaigns    <- ``customer``: ad id = c_custkey, 10 ads per campaign
  (``'c' || c_custkey div 10``); the ads that no customer has give ``UNKNOWN``.
* series       <- ``events``: one series per event type, ``ts`` = 1704067200 +
  event_id (10-digit seconds).
* samples      <- the same rows as metric samples with the labels ``pod``
  (``pod-`` || user_id % 4), ``job`` (``job-`` || user_id % 3) and ``operator_name``
  (``op-`` || event_id % 3); ``bucket`` > 1 groups events into shared seconds.  Of
  ``pod-3``, events of even id carry a label ``zone`` = ``z`` and the others have the
  pod ``pod-3,zone=z`` instead: two label sets that a plain text would make one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SERIES_BASE_S = 1_704_067_200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ad_id() -> Column:
    user = F.col("user_id").cast("string")
    return F.when(F.pmod(F.col("user_id"), F.lit(7)) == 3, F.concat(F.lit("x"), user)).otherwise(user)


def ad_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    event_time = F.date_trunc("second", F.col("ts").cast("timestamp"))
    return ev.select(
        ad_id().alias("ad_id"),
        F.unix_millis(event_time).alias("ts"),
        F.col("event_type").alias("et"),
        event_time.alias("event_time"),
    )


def wire_events(spark: SparkSession, sf_dir: str, faulty: bool = True) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    event_time = F.date_trunc("second", F.col("ts").cast("timestamp"))
    good = F.to_json(F.struct(
        F.unix_millis(event_time).cast("string").alias("ts"),
        ad_id().alias("id"),
        F.col("event_type").alias("et"),
    ))
    turn = F.pmod(F.col("event_id"), F.lit(4))
    bad = (F.when(turn == 0, F.col("props"))
           .when(turn == 1, F.lit('{"ts":1700000000000,"id":"a","et":"view"}'))
           .when(turn == 2, F.lit('{"ts":" 1700000000000","id":"a","et":"view"}'))
           .otherwise(F.lit('{"ts":"1700000000000","id":7,"et":"view"}')))
    value = F.when(F.col("event_type") == "error", bad).otherwise(good) if faulty else good
    return ev.select(
        F.col("user_id").cast("string").alias("key"),
        value.alias("value"),
        event_time.alias("timestamp"),
        F.pmod(F.col("user_id"), F.lit(4)).cast("int").alias("partition"),
        F.col("event_id").alias("offset"),
    )


def campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    cu = table(spark, sf_dir, "customer")
    return cu.select(
        F.col("c_custkey").cast("string").alias("ad_id"),
        F.concat(F.lit("c"), F.floor(F.col("c_custkey") / 10).cast("long").cast("string"))
        .alias("campaign_id"),
    )


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_type").alias("series_id"),
        (F.lit(SERIES_BASE_S) + F.col("event_id")).alias("ts"),
        "value",
    )


def samples(spark: SparkSession, sf_dir: str, bucket: int = 1) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    number = F.pmod(F.col("user_id"), F.lit(4))
    zoned = (number == 3) & (F.pmod(F.col("event_id"), F.lit(2)) == 0)
    pod = F.concat(F.lit("pod-"), number.cast("string"), F.when((number == 3) & ~zoned, F.lit(",zone=z")).otherwise(F.lit("")))
    job = F.concat(F.lit("job-"), F.pmod(F.col("user_id"), F.lit(3)).cast("string"))
    operator = F.concat(F.lit("op-"), F.pmod(F.col("event_id"), F.lit(3)).cast("string"))
    ts = F.lit(SERIES_BASE_S) + (F.col("event_id") if bucket == 1
                                 else F.floor(F.col("event_id") / bucket).cast("long"))
    return ev.select(
        F.col("event_type").alias("metric"),
        F.map_filter(F.create_map(F.lit("pod"), pod, F.lit("namespace"), F.lit("default"), F.lit("job"), job,
                                  F.lit("operator_name"), operator, F.lit("zone"), F.when(zoned, F.lit("z"))),
                     lambda k, v: v.isNotNull()).alias("labels"),
        ts.cast("long").alias("ts"),
        "value",
    )


def matrix_docs(samples: DataFrame, span: int = 11_000) -> DataFrame:
    """Samples as range-query documents: one per (metric, label set, ``span`` seconds), numbered in
    ``doc`` by span and label set; null values are written ``NaN``."""
    span_start = (F.floor(F.col("ts") / F.lit(span)) * F.lit(span)).cast("long")
    labels = F.map_concat(F.create_map(F.lit("__name__"), F.col("metric")), F.col("labels"))
    val = F.coalesce(F.col("value").cast("string"), F.lit("NaN"))
    docs = samples.groupBy("metric", "labels", span_start.alias("span")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("ts"), val.alias("v")))).alias("obs"))
    values = F.transform("obs", lambda o: F.array(o["ts"].cast("string"), o["v"]))
    doc = F.struct(F.lit("success").alias("status"), F.struct(F.lit("matrix").alias("resultType"), F.array(
        F.struct(labels.alias("metric"), values.alias("values"))).alias("result")).alias("data"))
    return docs.select("span", "metric", "labels", F.to_json(doc).alias("json"))
