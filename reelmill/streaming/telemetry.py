"""Resource telemetry: windowed rollups and run numbering, as batch operators and as streams.

A log has one or many sources (a column ``source``, the producer that wrote it); runs are counted within their source.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import TimerValues

from ..functions.columns import event_time, exact_mean
from ..operators.ordering import sums_before
from .jobs import needs_rocksdb

#: Measured columns of a sample; a log may lack some.
MEASURES = ("decode_qsize", "index_qsize", "cpu_percent", "memory_rss_mb", "system_cpu_percent", "system_ram_percent")
RUN_START, RUN_STOP = "pipeline_start", "pipeline_stop"


def measured(telemetry: DataFrame) -> list[str]:
    return [m for m in MEASURES if m in telemetry.columns]


def source_keys(telemetry: DataFrame) -> list[str]:
    return ["source"] if "source" in telemetry.columns else []


def samples(telemetry: DataFrame) -> DataFrame:
    """Measurements without the start and stop markers."""
    return telemetry.filter(F.col("event").isNull())


def telemetry_rollup(telemetry: DataFrame, window: str = "1 minute", slide: str | None = None, watermark: str | None = None) -> DataFrame:
    """Queue depth, CPU and memory per time window; give ``watermark`` on a stream."""
    rows = samples(telemetry).withColumn("event_time", event_time())
    if watermark is not None:
        rows = rows.withWatermark("event_time", watermark)
    frame = F.window("event_time", window, slide) if slide else F.window("event_time", window)
    found = measured(telemetry)
    means = [exact_mean(F.col(m)).alias(f"avg_{m}") for m in found]
    highest = [F.max(m).alias(f"max_{m}") for m in found]
    rolled = rows.groupBy(frame.alias("w")).agg(F.count("*").alias("samples"), *means, *highest)
    return rolled.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *rolled.columns[1:])


def session_rollup(telemetry: DataFrame, gap: str = "10 seconds", watermark: str | None = None) -> DataFrame:
    """Samples grouped into sessions that end after ``gap`` without one."""
    rows = samples(telemetry).withColumn("event_time", event_time())
    if watermark is not None:
        rows = rows.withWatermark("event_time", watermark)
    return rows.groupBy(F.session_window("event_time", gap).alias("w")).agg(
        F.count("*").alias("samples"), exact_mean(F.col("cpu_percent")).alias("avg_cpu_percent"), F.max("cpu_percent").alias("max_cpu_percent")
    ).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "samples", "avg_cpu_percent", "max_cpu_percent")


def with_run_id(telemetry: DataFrame, tie: str = "event_no") -> DataFrame:
    """``run_id``: how many start markers of its source came up to the row (batch form).

    Each source is numbered hour by hour and the hours' counts are carried across.
    """
    start = F.when(F.col("event") == RUN_START, 1).otherwise(0).cast("long")
    marked = telemetry.withColumn("_start", start)
    hours = [F.floor(F.col("timestamp") / F.lit(3600.0))]
    numbered = sums_before(marked, source_keys(telemetry), [F.asc("timestamp"), F.asc(tie)], hours, {"_earlier": F.col("_start")})
    return numbered.withColumn("run_id", F.col("_earlier") + F.col("_start")).drop("_earlier", "_start")


def run_rollup(telemetry: DataFrame, tie: str = "event_no") -> DataFrame:
    """Totals per run of a source, from its start marker to the next one."""
    return samples(with_run_id(telemetry, tie)).groupBy(*source_keys(telemetry), "run_id").agg(
        F.count("*").alias("samples"),
        F.min("timestamp").alias("first_sample"),
        F.max("timestamp").alias("last_sample"),
        *[F.max(m).alias(f"max_{m}") for m in measured(telemetry)],
    )


class RunTotals(StatefulProcessor):
    """Runs of one source. Rows wait until the watermark has passed them and are then taken in their order.

    State is one row for the open run and the rows of the watermark's delay.
    """

    def __init__(self, measures: list[str]) -> None:
        self.measures = measures

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = ", ".join(f"{m} double" for m in self.measures)
        self.handle = handle
        self.run = handle.getValueState("run", f"run_id long, samples long, first_sample double, last_sample double, {fields}")
        self.waiting = handle.getListState("waiting", f"timestamp double, event_no long, event string, {fields}")

    def _wake(self, at_ms: int) -> None:
        for timer in list(self.handle.listTimers()):
            at_ms = min(at_ms, timer)
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            held = batch[["timestamp", "event_no", "event", *self.measures]].astype(object).where(lambda x: x.notna(), None)
            self.waiting.appendList(list(held.itertuples(index=False, name=None)))
            earliest = float(batch["timestamp"].min())
            first = earliest if first is None else min(first, earliest)
        if first is not None:
            self._wake(max(int(first * 1000), timerValues.getCurrentWatermarkInMs() + 1))
        return
        yield

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() / 1000.0
        rows = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: r[:2])
        ready, later = [r for r in rows if r[0] <= passed], [r for r in rows if r[0] > passed]
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(int(later[0][0] * 1000) + 1)  # the expired one goes by itself
        else:
            self.waiting.clear()
        state = list(self.run.get()) if self.run.exists() else [0, 0, None, None, *[None] * len(self.measures)]
        done = []
        for at, _, event, *values in ready:
            if event == RUN_START:
                if state[1]:
                    done.append((*key, *state))
                state = [state[0] + 1, 0, None, None, *[None] * len(self.measures)]
            elif event is None:
                best = [v if s is None else s if v is None else max(s, v) for s, v in zip(state[4:], values)]
                state = [state[0], state[1] + 1, at if state[2] is None else state[2], at, *best]
        self.run.update(tuple(state))
        if state[1] and ready:
            done.append((*key, *state))
        if done:
            yield pd.DataFrame(done, columns=["source", "run_id", "samples", "first_sample", "last_sample", *[f"max_{m}" for m in self.measures]])

    def close(self) -> None:
        pass


def run_rollup_stream(telemetry: DataFrame, watermark: str = "1 minute") -> DataFrame:
    """:func:`run_rollup` over a stream: the totals of a run each time the watermark has let some of its rows through.

    Of the rows of one run the one with the most samples is the latest; a run's last row comes with the next start marker.
    """
    needs_rocksdb(telemetry)
    found = measured(telemetry)
    source = F.col("source") if "source" in telemetry.columns else F.lit("")
    slim = telemetry.select(source.alias("source"), "timestamp", "event_no", "event", *[F.col(m).cast("double").alias(m) for m in found])
    timed = slim.withColumn("event_time", event_time()).withWatermark("event_time", watermark)
    output = "source string, run_id long, samples long, first_sample double, last_sample double, " + ", ".join(f"max_{m} double" for m in found)
    return timed.groupBy("source").transformWithStateInPandas(RunTotals(found), output, "append", "EventTime")
