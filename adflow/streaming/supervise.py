"""A supervisor for one streaming query: failures borne, a time limit per batch, the checkpoint removed on cancel.

A query runs one batch at a time and goes on from its checkpoint when it is
started again.  ``supervise`` starts it, watches its progress, and starts it anew
after a failure; a batch that is done sets the count of failures back.  A batch
that takes longer than its limit is a failure, too.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

# Fixed values of the job: failures in a row that are borne, and the time limit of a batch.
TOLERATED = 3
BATCH_SECONDS = 120.0


class BatchTimeout(RuntimeError):
    """A batch took longer than its limit."""


class TooManyFailures(RuntimeError):
    """More failures in a row than are borne; the last one is the cause."""


@dataclass
class Outcome:
    """How a supervised query ended: ``finished``, ``cancelled`` or ``stopped``, with the failures on the way."""

    state: str
    starts: int
    failures: list[BaseException] = field(default_factory=list)


def remove_checkpoint(spark: SparkSession, checkpoint: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(checkpoint)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _batch(query: StreamingQuery) -> int:
    last = query.lastProgress
    return -1 if last is None else int(last["batchId"])


def supervise(spark: SparkSession, start: Callable[[], StreamingQuery], checkpoint: str, tolerated: int = TOLERATED,
              batch_seconds: float = BATCH_SECONDS, cancel: threading.Event | None = None,
              stop: threading.Event | None = None, poll: float = 0.2, backoff: float = 0.0) -> Outcome:
    """Run the query that ``start`` starts until it ends by itself or ``cancel`` (or ``stop``) is set.

    ``start`` is called again after each failure and must use ``checkpoint``.  A
    cancelled query is stopped and its checkpoint removed; one that has failed
    more than ``tolerated`` times in a row raises, and keeps its checkpoint, as
    one does that was told to ``stop``.
    """
    cancel, stop = cancel or threading.Event(), stop or threading.Event()
    failures: list[BaseException] = []
    in_a_row = starts = 0
    done = -1   # the highest batch known to be done
    while True:
        query = None
        try:
            query = start()
            starts += 1
            since = time.monotonic()
            while not query.awaitTermination(poll):
                if cancel.is_set() or stop.is_set():
                    query.stop()
                    if cancel.is_set():
                        remove_checkpoint(spark, checkpoint)
                    return Outcome("cancelled" if cancel.is_set() else "stopped", starts, failures)
                if _batch(query) > done:
                    done, in_a_row, since = _batch(query), 0, time.monotonic()
                elif not query.status["isTriggerActive"]:   # nothing to do
                    since = time.monotonic()
                elif time.monotonic() - since > batch_seconds:
                    raise BatchTimeout(f"batch {done + 1} took more than {batch_seconds} s")
            return Outcome("finished", starts, failures)
        except Exception as e:  # noqa: BLE001  whatever fails a batch is counted
            if query is not None:
                if _batch(query) > done:
                    done, in_a_row = _batch(query), 0
                query.stop()
            failures.append(e)
            in_a_row += 1
            if in_a_row > tolerated:
                raise TooManyFailures(f"{in_a_row} failures in a row") from e
            time.sleep(backoff)


def supervise_all(spark: SparkSession, parts: list[tuple[str, Callable[[], StreamingQuery]]], cancel: threading.Event,
                  **limits) -> list[Outcome]:
    """Supervise several queries ``(checkpoint, start)`` of one job; if one gives up, the others are stopped
    (their checkpoints stay) and its error is raised."""
    outcomes: list[Outcome | None] = [None] * len(parts)
    errors: list[BaseException] = []
    given_up = threading.Event()

    def run(n: int, checkpoint: str, start: Callable[[], StreamingQuery]) -> None:
        try:
            outcomes[n] = supervise(spark, start, checkpoint, cancel=cancel, stop=given_up, **limits)
        except BaseException as e:  # noqa: BLE001  raised again below
            errors.append(e)
            given_up.set()

    threads = [threading.Thread(target=run, args=(n, *part)) for n, part in enumerate(parts)]
    for t in threads:
        t.start()
    for t in threads:
        while t.is_alive():   # leaves room for signals
            t.join(0.5)
    if errors:
        raise errors[0]
    return [o for o in outcomes if o is not None]
