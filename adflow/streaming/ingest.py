"""The job's first stage: decode and enrich each micro-batch, good and malformed records from one pass.

Every batch reads the campaign table anew, so an ad that is added while the job
runs gets its campaign from the next batch on, and a miss is never remembered.
The records are decoded once and written once: events as Parquet below
``kind=event``, malformed records, as they came, below ``kind=malformed``.  A
batch is written aside and moved into place as a folder ``batch=<n>``; a batch
that is repeated after a restart finds its folder and writes nothing, so both
outputs hold every record once.  The windows run on :func:`events_stream`, which
follows that folder (a watermark needs whole batches, which the move gives).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from adflow.operators.enrich import UNKNOWN, enrich
from adflow.sources.campaigns import current_campaigns
from adflow.sources.events import WIRE_COLUMNS, decode_all

EVENT = "ad_id string, campaign_id string, ts long, et string, event_time timestamp"
MALFORMED = "key string, value string, timestamp timestamp, partition int, offset long"


def both_kinds(wire: DataFrame, campaigns: DataFrame, unknown: str = UNKNOWN) -> DataFrame:
    """Wire rows -> one table with ``kind`` ``event`` (columns of ``EVENT``) or ``malformed`` (columns of the wire)."""
    whole = decode_all(wire)
    good = F.col("event").isNotNull()
    raw = [F.when(~good, F.col(f"wire.{c}")).alias(c) for c in WIRE_COLUMNS if c in wire.columns]
    rows = whole.select(F.when(good, F.lit("event")).otherwise(F.lit("malformed")).alias("kind"), F.col("event.ad_id").alias("ad_id"),
                        F.col("event.ts").alias("ts"), F.col("event.et").alias("et"), F.col("event.event_time").alias("event_time"), *raw)
    named = enrich(rows, campaigns, unknown)
    return named.withColumn("campaign_id", F.when(F.col("kind") == "event", F.col("campaign_id")))


def write_batch_once(rows: DataFrame, path: str, batch: int, partition_by: str = "kind") -> bool:
    """Write ``rows`` as folder ``batch=<n>`` of ``path``; nothing if it is there. Whether it was written."""
    spark = rows.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    path = path.rstrip("/")
    place, aside = hadoop(f"{path}/batch={batch:09d}"), f"{path}/_writing/batch={batch:09d}"
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(place):
        return False
    rows.write.mode("overwrite").partitionBy(partition_by).parquet(aside)
    if not fs.rename(hadoop(aside), place):
        raise OSError(f"cannot move {aside} to {place}")
    return True


def ingest(wire: DataFrame, campaigns: str, path: str, checkpoint: str, trigger: dict | None = None,
           query_name: str | None = None) -> StreamingQuery:
    """Start the stage: stream ``wire`` -> batches below ``path``, with the campaign table in folder ``campaigns``."""
    spark = wire.sparkSession

    def put(rows: DataFrame, batch: int) -> None:
        write_batch_once(both_kinds(rows, current_campaigns(spark, campaigns)), path, batch)

    w = wire.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put)
    if query_name:
        w = w.queryName(query_name)
    return w.trigger(**(trigger or {"processingTime": "1 second"})).start()


def _kind(spark: SparkSession, path: str, kind: str, schema: str, options: dict | None, streaming: bool) -> DataFrame:
    reader = (spark.readStream if streaming else spark.read).schema(f"{schema}, batch long, kind string")
    return reader.options(**(options or {})).parquet(path).where(F.col("kind") == kind).drop("batch", "kind")


def events(spark: SparkSession, path: str) -> DataFrame:
    """All decoded, enriched events so far."""
    return _kind(spark, path, "event", EVENT, None, False)


def events_stream(spark: SparkSession, path: str, options: dict | None = None) -> DataFrame:
    """The decoded, enriched events as they come; the folder may be empty yet."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(folder)
    return _kind(spark, path, "event", EVENT, options, True)


def malformed(spark: SparkSession, path: str) -> DataFrame:
    """The records that are no ad events, as they came."""
    return _kind(spark, path, "malformed", MALFORMED, None, False)
