"""Run the ad job as a Structured Streaming query.

source (Kafka topic, or replayed files of the same row shape) -> decode ->
event time + 1 s watermark -> pipeline mode -> message text -> sink.

Sinks: ``kafka`` (at-least-once in Spark), ``text`` / ``json`` files
(exactly-once through the file sink's commit log), ``batches`` (exactly-once:
each micro-batch replaces the folder ``batch_id=<n>``, so a retried batch cannot
double a message), ``memory`` (tests).  State lives in RocksDB; the trigger
interval is the checkpoint interval.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from adflow.config import PipelineConfig
from adflow.plans.pipeline import has_sink, messages
from adflow.session import ROCKSDB_PROVIDER
from adflow.sources.events import decode

STATE_PROVIDER_KEY = "spark.sql.streaming.stateStore.providerClass"


def use_rocksdb(spark: SparkSession) -> None:
    """RocksDB state (set before the first start of a query; fixed afterwards)."""
    if not spark.conf.get(STATE_PROVIDER_KEY, None) or \
            "HDFSBackedStateStoreProvider" in spark.conf.get(STATE_PROVIDER_KEY):
        spark.conf.set(STATE_PROVIDER_KEY, ROCKSDB_PROVIDER)


def job_messages(config: PipelineConfig, wire: DataFrame, campaigns: DataFrame,
                 decode_mode: str = "failfast") -> DataFrame:
    """Wire rows -> message ``value`` rows of the configured mode."""
    return messages(config, decode(wire, mode=decode_mode), campaigns)


def write_batch(messages_: DataFrame, path: str, batch_id: int) -> None:
    """The messages of one micro-batch, in place of what an earlier attempt left."""
    messages_.write.mode("overwrite").text(f"{path.rstrip('/')}/batch_id={int(batch_id)}")


def start(config: PipelineConfig, wire: DataFrame, campaigns: DataFrame, checkpoint: str,
          sink: str = "text", path: str | None = None, options: dict | None = None,
          trigger: dict | None = None, query_name: str | None = None) -> StreamingQuery:
    """Start the job; ``wire`` is a streaming DataFrame of Kafka-shaped rows."""
    if not has_sink(config):
        raise ValueError("neither join nor aggregate is applied: nothing to write")
    return start_messages(config, job_messages(config, wire, campaigns), checkpoint, sink, path, options, trigger, query_name)


def start_messages(config: PipelineConfig, out: DataFrame, checkpoint: str, sink: str = "text", path: str | None = None,
                   options: dict | None = None, trigger: dict | None = None, query_name: str | None = None) -> StreamingQuery:
    """Write the stream ``out`` of message ``value`` rows to the job's sink."""
    use_rocksdb(out.sparkSession)
    w = (out.writeStream.outputMode("append")
         .option("checkpointLocation", checkpoint)
         .queryName(query_name or config.job_name))
    if trigger is None:
        trigger = {"processingTime": f"{config.checkpoint_interval_ms} milliseconds"}
    w = w.trigger(**trigger)
    opts = dict(options or {})
    if sink == "kafka":
        opts.setdefault("kafka.bootstrap.servers", config.brokers)
        opts.setdefault("topic", config.sink_topic)
        return w.format("kafka").options(**opts).start()
    if sink == "memory":
        return w.format("memory").start()
    if path is None:
        raise ValueError("file sinks need a path")
    if sink == "batches":
        return w.foreachBatch(lambda df, n: write_batch(df, path, n)).start()
    return w.format(sink).options(**opts).start(path)
