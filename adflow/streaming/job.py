"""The ad job as a program: nine arguments, and where its data lies.

    python -m adflow.streaming.job jobName brokers sourceTopic sinkTopic \\
        checkpointIntervalMs windowKind windowSizeMs applyJoin applyAggregate \\
        --campaigns DIR --checkpoint DIR [--staged DIR] [--source-files DIR]
        [--sink kafka|batches|text] [--sink-path DIR]

Without ``--source-files`` the source is the Kafka topic; with it, files of the
same row shape are replayed.  The campaign table is loaded once, at the start,
and checked to name every ad once; a malformed record stops the job.  With
``--staged`` the job is two queries: the first reads the (versioned) campaign table
anew for each micro-batch and puts events and malformed records there, the
second works on the events.  ``batches`` is the sink that survives restarts
without a doubled or lost message: every micro-batch replaces its own folder.
Failed batches are tried again, and a signal to stop removes the checkpoints
(:mod:`adflow.streaming.supervise`).
"""

from __future__ import annotations

import argparse
import signal
import sys
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from adflow.config import PipelineConfig
from adflow.plans.pipeline import as_messages, build_enriched
from adflow.session import get_session
from adflow.sources.campaigns import load_campaigns
from adflow.sources.events import read_events
from adflow.streaming.ingest import events_stream, ingest
from adflow.streaming.runner import start, start_messages
from adflow.streaming.supervise import supervise_all

WIRE_SCHEMA = "key string, value string, timestamp timestamp"


def source(spark: SparkSession, config: PipelineConfig, files: str | None = None,
           options: dict[str, str] | None = None) -> DataFrame:
    """The job's stream of wire rows: its topic, or replayed parquet files."""
    if files is not None:
        return read_events(spark, "parquet", options, path=files, schema=WIRE_SCHEMA, streaming=True)
    kafka = {"kafka.bootstrap.servers": config.brokers, "subscribe": config.source_topic, **(options or {})}
    return read_events(spark, "kafka", kafka, streaming=True, starting_offsets=config.starting_offsets)


def launch(spark: SparkSession, args: list[str], campaigns: str, checkpoint: str, source_files: str | None = None,
           sink: str = "kafka", sink_path: str | None = None, source_options: dict[str, str] | None = None,
           trigger: dict | None = None) -> StreamingQuery:
    """Start the job of the nine ``args``."""
    config = PipelineConfig.from_args(args)
    wire = source(spark, config, source_files, source_options)
    return start(config, wire, load_campaigns(spark, campaigns), checkpoint, sink=sink, path=sink_path, trigger=trigger)


def launch_ingest(spark: SparkSession, args: list[str], campaigns: str, staged: str, checkpoint: str,
                  source_files: str | None = None, source_options: dict[str, str] | None = None,
                  trigger: dict | None = None) -> StreamingQuery:
    """Start the first query of the staged job: the source, decoded and enriched, into folder ``staged``."""
    config = PipelineConfig.from_args(args)
    return ingest(source(spark, config, source_files, source_options), campaigns, staged, checkpoint, trigger,
                  f"{config.job_name}-ingest")


def launch_windows(spark: SparkSession, args: list[str], staged: str, checkpoint: str, sink: str = "kafka",
                   sink_path: str | None = None, source_options: dict[str, str] | None = None,
                   trigger: dict | None = None) -> StreamingQuery:
    """Start the second query of the staged job: the events of folder ``staged`` to the sink."""
    config = PipelineConfig.from_args(args)
    out = as_messages(config, build_enriched(config, events_stream(spark, staged, source_options)))
    return start_messages(config, out, checkpoint, sink=sink, path=sink_path, trigger=trigger)


def main(argv: list[str]) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("args", nargs=9, metavar="ARG")
    parser.add_argument("--campaigns", required=True)
    parser.add_argument("--checkpoint", required=True)
    parser.add_argument("--staged")
    parser.add_argument("--source-files")
    parser.add_argument("--sink", default="kafka", choices=["kafka", "batches", "text"])
    parser.add_argument("--sink-path")
    opts = parser.parse_args(argv)
    spark = get_session(opts.args[0])
    cancel = threading.Event()
    for number in (signal.SIGINT, signal.SIGTERM):
        signal.signal(number, lambda *_: cancel.set())
    if opts.staged:
        mark, out = f"{opts.checkpoint}/ingest", f"{opts.checkpoint}/windows"
        parts = [(mark, lambda: launch_ingest(spark, opts.args, opts.campaigns, opts.staged, mark, opts.source_files)),
                 (out, lambda: launch_windows(spark, opts.args, opts.staged, out, opts.sink, opts.sink_path))]
    else:
        parts = [(opts.checkpoint, lambda: launch(spark, opts.args, opts.campaigns, opts.checkpoint, opts.source_files,
                                                  opts.sink, opts.sink_path))]
    supervise_all(spark, parts, cancel)


if __name__ == "__main__":
    main(sys.argv[1:])
