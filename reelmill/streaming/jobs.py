"""Job progress and latest state, as batch operators and as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import TimerValues

from ..functions.columns import event_time, round_to

TERMINAL = {"completed": "COMPLETED", "error": "FAILED", "cancelled": "CANCELLED"}
SILENCE_SECONDS = 15


def progress(events: DataFrame) -> DataFrame:
    """Percent, rate and elapsed seconds per job and stage; works on a batch and on a stream.

    ``events``: job_id, stage, processed, total, timestamp. A total of 0 is 100 percent.
    """
    grouped = events.groupBy("job_id", "stage").agg(
        F.max("processed").alias("processed"), F.max("total").alias("total"),
        F.min("timestamp").alias("_first"), F.max("timestamp").alias("_last"),
    )
    return _progress_row(grouped, F.col("_first"), F.col("_last"))


def _progress_row(rows: DataFrame, first: Column, last: Column) -> DataFrame:
    elapsed = last - first
    percent = F.when(F.col("total") > 0, F.col("processed") / F.col("total") * F.lit(100.0)).otherwise(F.lit(100.0))
    rate = F.when(elapsed > 0, F.col("processed") / elapsed).otherwise(F.lit(0.0))
    return rows.select(
        "job_id", "stage", "processed", "total", round_to(percent, 4).alias("percentage"), round_to(rate, 6).alias("files_per_second"),
        round_to(elapsed, 3).alias("elapsed_seconds"),
    )


class StageTotals(StatefulProcessor):
    """Highest counts and the first and last time of one (job, stage); forgotten once the watermark is ``idle`` past its last event."""

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", "processed long, total long, first double, last double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        held = self.totals.get() if self.totals.exists() else None
        for batch in rows:
            new = (int(batch["processed"].max()), int(batch["total"].max()), float(batch["first"].min()), float(batch["last"].max()))
            held = new if held is None else (max(held[0], new[0]), max(held[1], new[1]), min(held[2], new[2]), max(held[3], new[3]))
        if held is None:
            return
        self.totals.update(tuple(held))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(int(held[3] * 1000) + self.idle_ms, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame([(*key, *held)], columns=["job_id", "stage", "processed", "total", "first", "last"])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.totals.clear()
        return
        yield

    def close(self) -> None:
        pass


def progress_stream(events: DataFrame, watermark: str = "1 minute", idle_seconds: float = 60.0) -> DataFrame:
    """:func:`progress` over a stream that never ends: a row per (job, stage) and batch in which it moves.

    ``events`` needs ``event_no``: a replayed event is dropped while the watermark has not passed it. The state of a stage goes
    when the watermark is ``idle_seconds`` past its last event, so finished jobs take no room.
    """
    needs_rocksdb(events)
    slim = events.select("job_id", "stage", "event_no", F.col("processed").cast("long"), F.col("total").cast("long"), "timestamp")
    timed = slim.withColumn("event_time", event_time()).withWatermark("event_time", watermark)
    once = timed.dropDuplicatesWithinWatermark(["job_id", "event_no"])
    rows = once.select("job_id", "stage", "processed", "total", F.col("timestamp").alias("first"), F.col("timestamp").alias("last"), "event_time")
    held = rows.groupBy("job_id", "stage").transformWithStateInPandas(
        StageTotals(int(idle_seconds * 1000)), "job_id string, stage string, processed long, total long, first double, last double", "append", "EventTime"
    )
    return _progress_row(held, F.col("first"), F.col("last"))


def _status() -> Column:
    kind = F.col("event_type")
    choice = F.lit("RUNNING")
    for event, status in TERMINAL.items():
        choice = F.when(kind == event, status).otherwise(choice)
    return choice


def latest_job_state(events: DataFrame, now: float | None = None) -> DataFrame:
    """Newest event per job with its status; ``needs_check`` marks live jobs silent for 15 seconds.

    Batch form; one partial maximum per task and job. ``event_no`` breaks ties in time.
    """
    order = F.struct("timestamp", "event_no")
    newest = events.groupBy("job_id").agg(
        F.max_by(F.struct("event_type", "stage", "progress_pct", "message", "timestamp", "event_no"), order).alias("_e"),
        F.count("*").alias("events"),
    )
    flat = newest.select("job_id", "_e.*", "events").withColumn("status", _status())
    silent = F.lit(False) if now is None else F.lit(now) - F.col("timestamp") >= SILENCE_SECONDS
    return flat.withColumn("progress_pct", round_to(F.col("progress_pct"), 1)).withColumn(
        "needs_check", (F.col("status") == "RUNNING") & silent
    )


class JobStates(StatefulProcessor):
    """Newest event of each job. Timers in event time tell silence, and when an ended job may be forgotten.

    One row per job is kept. An ended job stays known until the watermark has passed its end, so a late or replayed event
    can't open it again.
    """

    columns = ["job_id", "status", "stage", "progress_pct", "timestamp", "event_no", "needs_check"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "status string, stage string, progress_pct double, timestamp double, event_no long")

    def _rows(self, key: tuple, state: tuple, silent: bool) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame([(key[0], *state, silent)], columns=self.columns)

    def _wake(self, at: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        before = tuple(self.newest.get()) if self.newest.exists() else None
        best = before
        for batch in rows:
            top = batch.sort_values(["timestamp", "event_no"]).iloc[-1]
            seen = (top["status"], top["stage"], float(top["progress_pct"]), float(top["timestamp"]), int(top["event_no"]))
            if best is None or (seen[3], seen[4]) > (best[3], best[4]):
                best = seen
        if best is None or best == before:
            return
        self.newest.update(best)
        wait = 1 if best[0] in TERMINAL.values() else SILENCE_SECONDS * 1000
        self._wake(max(int(best[3] * 1000) + wait, timerValues.getCurrentWatermarkInMs() + 1))
        yield from self._rows(key, best, False)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = tuple(self.newest.get())
        if state[0] in TERMINAL.values():
            self.newest.clear()  # no older event can come any more
            return
        self.handle.registerTimer(timerValues.getCurrentWatermarkInMs() + SILENCE_SECONDS * 1000)
        yield from self._rows(key, state, True)

    def close(self) -> None:
        pass


def needs_rocksdb(df: DataFrame) -> None:
    """Timers and typed state live in RocksDB; ``build_session`` sets it."""
    provider = df.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass", "")
    if "RocksDB" not in provider:
        raise ValueError("spark.sql.streaming.stateStore.providerClass must be the RocksDB state store")


def latest_job_state_stream(events: DataFrame, watermark: str = "1 minute") -> DataFrame:
    """The same over a stream: a row per job and change, and one with ``needs_check`` after 15 s of silence.

    Late rows beyond the watermark are dropped by Spark and counted in the query's progress.
    """
    needs_rocksdb(events)
    output = "job_id string, status string, stage string, progress_pct double, timestamp double, event_no long, needs_check boolean"

    def newest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.sort_values(["timestamp", "event_no"]).drop_duplicates("job_id", keep="last")

    slim = events.withColumn("status", _status()).select("job_id", "status", "stage", "progress_pct", "timestamp", "event_no")
    # only the newest event of a job can matter, so a busy job is thinned out before the shuffle
    thinned = slim.mapInPandas(newest, slim.schema)
    timed = thinned.withColumn("event_time", event_time()).withWatermark("event_time", watermark)
    return timed.groupBy("job_id").transformWithStateInPandas(JobStates(), output, "append", "EventTime")
