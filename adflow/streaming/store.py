"""Latest count per (campaign, window): plain Parquet, partitioned by window and micro-batch.

Every micro-batch (or batch call) writes its updated rows in place of what an
earlier attempt of it left, so a batch that is run again doubles nothing.  The
count of a key is the one of its highest batch.  A window's folder holds a row
per update of that window, and a query for some windows reads their folders only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

KEY = ("campaign_id", "window_end")
ROW = "campaign_id string, count long, updated_at timestamp, window_end long, batch_id long"


def upsert_counts(updates: DataFrame, path: str, batch_id: int) -> None:
    """Store the rows of one batch (``campaign_id, count, window_end``)."""
    out = updates.select("campaign_id", "count", F.current_timestamp().alias("updated_at"), "window_end",
                         F.lit(int(batch_id)).cast("long").alias("batch_id"))
    (out.repartition("window_end").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("window_end", "batch_id").parquet(path))


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """``campaign_id, window_end, count, updated_at``, one row per key."""
    latest = spark.read.schema(ROW).parquet(path).groupBy(*KEY).agg(
        F.max_by(F.struct("count", "updated_at"), "batch_id").alias("__r"))
    return latest.select(*KEY, "__r.count", "__r.updated_at")


def store_stream(counts: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Run a streaming count into the table (``update`` output mode)."""
    w = (counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
         .foreachBatch(lambda rows, batch: upsert_counts(rows, path, batch)))
    return w.trigger(**(trigger or {"availableNow": True})).start()
