"""What running queries skipped: a listener that adds up, per query, the counters of every micro-batch
(:func:`adflow.functions.counting.counted`) and the rows that the watermark dropped.

Late rows are counted as the stateful operator meets them: behind a partial
aggregation, rows of one group and task are one.
"""

from __future__ import annotations

import threading
from collections import defaultdict

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener

LATE = "late_rows"
BATCHES = "batches"


class Trace(StreamingQueryListener):
    """Counters of the session's queries while the context is open."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.lock = threading.Condition()
        self.sums: dict[str, dict[str, dict[str, int]]] = defaultdict(lambda: defaultdict(lambda: defaultdict(int)))
        self.ended: set[str] = set()
        self.late: dict[str, int] = defaultdict(int)
        self.batches: dict[str, int] = defaultdict(int)

    def __enter__(self) -> Trace:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        self.spark.streams.removeListener(self)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        with self.lock:
            of = str(p.id)
            self.batches[of] += 1
            self.late[of] += sum(o.numRowsDroppedByWatermark for o in p.stateOperators)
            for name, row in p.observedMetrics.items():
                for counter, n in row.asDict().items():
                    self.sums[of][name][counter] += int(n or 0)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self.lock:
            self.ended.add(str(event.runId))
            self.lock.notify_all()

    def of(self, query, wait: float = 30.0) -> dict[str, dict[str, int]]:
        """The counters of ``query`` so far, by name; of a query that is over, all of them."""
        with self.lock:
            if not query.isActive:
                self.lock.wait_for(lambda: str(query.runId) in self.ended, wait)
            of = str(query.id)
            out = {name: dict(counters) for name, counters in self.sums[of].items()}
            return out | {LATE: {"rows": self.late[of]}, BATCHES: {"rows": self.batches[of]}}
