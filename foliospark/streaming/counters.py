"""Counters that fill while a job runs: tokens and documents of calls, and the progress of streams, without a second pass."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

CALLS = "calls"


def _sums() -> list:
    return [F.count("*").alias("docs"), F.coalesce(F.sum("tokens_in"), F.lit(0)).cast("long").alias("tokens_in"), F.coalesce(F.sum("tokens_out"), F.lit(0)).cast("long").alias("tokens_out")]


def counted(calls: DataFrame, name: str = CALLS) -> tuple[DataFrame, Observation]:
    """The rows (with tokens_in and tokens_out) as they are, and an observation whose ``get`` has docs, tokens_in and tokens_out once they have been computed for the first time."""
    seen = Observation(name)
    return calls.observe(seen, *_sums()), seen


def counted_stream(calls: DataFrame, name: str = CALLS) -> DataFrame:
    """The rows of a stream, counted batch by batch for a :class:`ProgressLog`."""
    return calls.observe(name, *_sums())


class ProgressLog(StreamingQueryListener):
    """Adds up what the batches of streams report: documents and tokens of counted rows, rows read, batches and the last one's number, by query."""

    def __init__(self, name: str = CALLS):
        self.name, self.totals, self.seen, self.lock, self.ended = name, {}, set(), threading.Lock(), {}

    def onQueryStarted(self, event) -> None:
        with self.lock:
            self.ended.setdefault(str(event.id), threading.Event()).clear()

    def onQueryProgress(self, event) -> None:
        p = event.progress
        with self.lock:
            if (str(p.id), str(p.runId), p.batchId) in self.seen:  # idle reports repeat the last batch
                return
            self.seen.add((str(p.id), str(p.runId), p.batchId))
            total = self.totals.setdefault(str(p.id), {"docs": 0, "tokens_in": 0, "tokens_out": 0, "rows_read": 0, "batches": 0, "last_batch": -1})
            row = p.observedMetrics.get(self.name)
            for k in ("docs", "tokens_in", "tokens_out") if row is not None else ():
                total[k] += row[k]
            total["rows_read"] += max(0, p.numInputRows)
            total["batches"] += p.numInputRows > 0
            total["last_batch"] = max(total["last_batch"], p.batchId)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self.lock:
            self.ended.setdefault(str(event.id), threading.Event()).set()

    def wait(self, query, timeout: float = 60.0) -> dict:
        """The totals of a query, once its end has been reported: reports come behind the query, on a thread of their own."""
        query.awaitTermination()
        with self.lock:
            ended = self.ended.setdefault(str(query.id), threading.Event())
        if not ended.wait(timeout):
            raise TimeoutError("the end of the stream was not reported")
        with self.lock:
            return dict(self.totals.get(str(query.id), {"docs": 0, "tokens_in": 0, "tokens_out": 0, "rows_read": 0, "batches": 0, "last_batch": -1}))


def logged(spark: SparkSession, start) -> dict:
    """Start a query with ``start()`` under a new log, wait for its end, and give its totals."""
    log = ProgressLog()
    spark.streams.addListener(log)
    try:
        return log.wait(start())
    finally:
        spark.streams.removeListener(log)
