"""Jobs as state machines over a stream of changes, with time-outs in event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..cluster import ship_package

CONFIRMED, RUNNING, FAILED = "confirmed", "processing", "error"
TRANSITIONS = "job_id long, number long, at_us long, status string, timed_out boolean"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class JobMachine(StatefulProcessor):
    """The life of each job, change by change, in the order of event time.

    A change waits in the state until the watermark has passed it, since one before it may still come; then it is applied in
    its place. So the transitions don't depend on how the stream was cut into batches.
    A job that stays ``processing`` for longer than ``limit_ms`` becomes ``error`` at that time; a later change still counts. ``confirmed`` is
    never left, and changes after it are not kept.
    """

    def __init__(self, limit_ms: int):
        self.limit_us = limit_ms * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "status string, at_us long, number long")
        self.waiting = handle.getListState("waiting", "at_us long, status string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        told = self.job.get()  # null if there is none
        new = [(int(t), s) for some in rows for t, s in zip(some["at_us"], some["status"])]
        if new and not (told and told[0] == CONFIRMED):
            self.waiting.appendList(new)
            self.handle.registerTimer(min(t for t, _ in new) // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        status, at, number = self.job.get() or (None, 0, 0)
        waiting = sorted((t, s) for t, s in self.waiting.get())
        due, later = [c for c in waiting if c[0] // 1000 < passed], [c for c in waiting if c[0] // 1000 >= passed]
        out: list[tuple] = []

        def go(t: int, to: str, timed_out: bool) -> None:
            nonlocal status, at, number
            status, at, number = to, t, number + 1
            out.append((key[0], number, t, to, timed_out))

        for t, to in due:
            if status == CONFIRMED:
                break
            if status == RUNNING and t > at + self.limit_us:
                go(at + self.limit_us, FAILED, True)
            go(t, to, False)
        if status == RUNNING and (at + self.limit_us) // 1000 < passed:
            go(at + self.limit_us, FAILED, True)
        if out:
            self.job.update((status, at, number))
        if due:
            if later and status != CONFIRMED:
                self.waiting.put(later)
            else:
                self.waiting.clear()
        if status != CONFIRMED and later:
            self.handle.registerTimer(later[0][0] // 1000)
        if status == RUNNING:
            self.handle.registerTimer((at + self.limit_us) // 1000)
        if out:
            yield pd.DataFrame(out, columns=["job_id", "number", "at_us", "status", "timed_out"])

    def close(self) -> None:
        pass


def job_transitions(changes: DataFrame, limit: str, delay: str) -> DataFrame:
    """The transitions of all jobs, as far as the watermark: job_id, number (from 1, by job), at, status, timed_out.

    changes is a stream of job_id, at (timestamp) and status. ``limit`` (such as "30 minutes") is how long a job may be ``processing``, ``delay`` how
    late a change may come; later ones are dropped, as Spark does. Of changes at one time the one whose status comes first by name is applied first. Rows with a null count
    for nothing. A transition is emitted once, when the watermark has passed it; write with :func:`foliospark.streaming.jobs.run_jobs`.
    The state is one row a job and the changes of the last ``delay``, in RocksDB, so that it needn't fit in memory.
    """
    spark = changes.sparkSession
    ship_package(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = changes.where("job_id is not null and at is not null and status is not null").withWatermark("at", delay)
    rows = rows.select(F.col("job_id").cast("long").alias("job_id"), "at", F.unix_micros("at").alias("at_us"), "status")
    ms = int(spark.sql(f"select unix_millis(timestamp_micros(0) + interval {limit}) as ms").first().ms)
    out = rows.groupBy("job_id").transformWithStateInPandas(JobMachine(ms), TRANSITIONS, "Append", "EventTime")
    return out.select("job_id", "number", F.timestamp_micros("at_us").alias("at"), "status", "timed_out")


def final_states(transitions: DataFrame) -> DataFrame:
    """job_id, status, changes, time_outs of jobs, from all their transitions."""
    return transitions.groupBy("job_id").agg(F.max_by("status", "number").alias("status"), F.count("*").alias("changes"), F.count_if("timed_out").alias("time_outs"))
