"""Streaming forms: intervals of the foreground window, idle sessions, batch-wise sinks.

Late rows are dropped behind a watermark; the batch operators see all rows, so both agree on what is in time.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from daytrace.session import ship

INTERVAL = "machine BIGINT, app STRING, start_ts DOUBLE, end_ts DOUBLE, n BIGINT"


def idle_sessions(events: DataFrame, key: str, ts: str, gap: str, delay: str = "1 hour") -> DataFrame:
    """Sessions of a key that end after ``gap`` without a row; a row at exactly the gap still belongs."""
    return events.withWatermark(ts, delay).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def interval_stream(events: DataFrame) -> DataFrame:
    """(machine, app, ts) to closed intervals: one ends where the machine's app changes. State is the open one."""
    ship(events.sparkSession)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        app, start, n = state.get if state.exists else (None, None, 0)
        out = []
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")
        for now, ts in zip(rows.app, rows.ts, strict=True):
            if start is not None and now == app:
                n += 1
                continue
            if start is not None:
                out.append((key[0], app, start, ts, n))
            app, start, n = now, ts, 1
        state.update((app, start, n))
        if out:
            yield pd.DataFrame(out, columns=["machine", "app", "start_ts", "end_ts", "n"])

    return events.groupBy("machine").applyInPandasWithState(step, INTERVAL, "app STRING, start_ts DOUBLE, n BIGINT", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, sink: Callable[[DataFrame, int], Any], checkpoint: str) -> None:
    """Run all that is there through ``sink`` (batch, number) and stop. Offsets live in the checkpoint; sinks must bear a repeat."""
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def once_per_batch(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that a repeated batch replaces instead of doubling."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return write


#: Why a run of ticks ended.
EMPTY, ERROR, PAUSED, CANCELLED = "empty", "error", "paused", "cancelled"


class _Marked(Exception):
    """A mark stopped a batch before it was written."""


def run_ticks(stream: DataFrame, sink: Callable[[DataFrame, int], Any], checkpoint: str, every: str = "30 seconds", mark: Callable[[], str | None] = lambda: None, poll_s: float = 0.1, conf: Mapping[str, str] = {}) -> str:
    """A batch per tick until nothing is left, a batch fails, or ``mark()`` says ``paused`` or ``cancelled``; why it ended.

    The mark is read before each batch is written and between ticks. A batch that fails or is marked is not committed, so
    the next run with this checkpoint begins with it: nothing is lost, and a sink by batch number doubles nothing.
    Processing-time timers fire in ticks, so streams with them end here and not in ``drain``. ``conf`` holds settings of this
    run alone: a stream copies the session's when it starts.
    """
    session = stream.sparkSession.conf
    before = {k: session.get(k, None) for k in conf}
    found: list[str] = []

    def write(batch: DataFrame, number: int) -> None:
        if why := mark():
            found.append(why)
            raise _Marked(why)
        sink(batch, number)

    try:
        for k, v in conf.items():
            session.set(k, v)
        running = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
    finally:
        for k, v in before.items():
            session.unset(k) if v is None else session.set(k, v)
    try:
        while running.isActive and not found:
            if why := mark():
                found.append(why)
                break
            last, status = running.lastProgress, running.status
            idle = not status["isTriggerActive"] and status["message"].startswith("Waiting") and not status["isDataAvailable"]
            if last is not None and last["numInputRows"] == 0 or idle:
                return EMPTY
            time.sleep(poll_s)
    finally:
        running.stop()
    return found[0] if found else ERROR if running.exception() is not None else EMPTY
