"""Event-time replay per key: rows wait in state until the watermark has passed them.

Files and partitions may deliver rows in any order, while clicks, sessions and cache entries depend on
the order of events. So each key holds back its rows, and once the watermark passes a moment, takes the
rows up to it in event order. Input that stays within the watermark delay gives the same result as the
batch operator; rows behind the watermark are dropped by Spark, which counts them in its metrics.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Moment in microseconds, order among rows of one moment, number, and one more value.
_WAITING = "us bigint, clase int, id bigint, extra bigint"
_ALARM = "ms bigint"


class OrderedReplay(StatefulProcessor):
    """Base of the keyed jobs. Rows come as (key columns, us, clase, id, extra).

    Subclasses name their memory layout and give `replay(key, memory, rows)`, which gets ordered
    (us, clase, id, extra) rows and returns the new memory (a tuple or None) and output rows.
    """

    memory_layout = "a bigint"
    columns: list[str] = []

    def replay(self, key: tuple, memory: tuple | None, rows: list[tuple]):
        raise NotImplementedError

    def expires(self, memory: tuple) -> int | None:
        """The moment (in microseconds) from which no row can need this memory any more; None: it is always kept."""
        return None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _WAITING)
        self.memory = handle.getValueState("memory", self.memory_layout)
        self.alarm = handle.getValueState("alarm", _ALARM)

    def _wake_at(self, us: int) -> None:
        ms = -(-us // 1000)
        if self.alarm.exists():
            current = self.alarm.get()[0]
            if current <= ms:
                return
            self.handle.deleteTimer(current)
        self.handle.registerTimer(ms)
        self.alarm.update((ms,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            fresh = list(zip(*(pdf[c].tolist() for c in ("us", "clase", "id", "extra"))))
            if fresh:
                self.waiting.appendList(fresh)
                low = min(r[0] for r in fresh)
                first = low if first is None else min(first, low)
        if first is not None:
            self._wake_at(first)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(tuple(r) for r in self.waiting.get())
        ready = [r for r in held if r[0] <= passed]
        rest = [r for r in held if r[0] > passed]
        self.alarm.clear()
        self.waiting.clear()
        memory = tuple(self.memory.get()) if self.memory.exists() else None
        memory, out = self.replay(key, memory, ready)
        end = None if memory is None else self.expires(memory)
        if memory is None or end is not None and end <= passed:
            self.memory.clear()
        else:
            self.memory.update(memory)
            if end is not None:
                self._wake_at(end)
        if rest:
            self.waiting.put(rest)
            self._wake_at(rest[0][0])
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


def _to_us(ts: Column) -> Column:
    """Microseconds of a wall-clock time, whatever zone the session has."""
    since = (ts - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")).cast("interval second")
    return (since.cast("decimal(20,6)") * F.lit(1_000_000)).cast("bigint")


def from_us(us: Column) -> Column:
    seconds = (us / F.lit(1_000_000).cast("decimal(10,0)")).cast("decimal(18,6)")
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)


def replay_stream(rows: DataFrame, keys: list[str], processor: OrderedReplay, output: str,
                  delay: str) -> DataFrame:
    """Output rows of the processor over (keys, ts, clase, id, extra), `ts` being the event time."""
    return (
        rows.select(*keys, _to_us(F.col("ts")).alias("us"), "clase", "id", "extra")
        .withColumn("momento", F.timestamp_micros("us"))
        .withWatermark("momento", delay)
        .groupBy(*keys)
        .transformWithStateInPandas(
            statefulProcessor=processor, outputStructType=output, outputMode="Append",
            timeMode="EventTime",
        )
    )
