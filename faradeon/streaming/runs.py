"""Runs and intervals of run logs as they grow: keyed state in event time.

Events wait in a key's state until the watermark has passed them, and are then taken in order of time, whatever order
and batch they came in. So a stream gives the rows that ``runlog.split_runs`` and ``runlog.intervals`` give of the same
events. What a key keeps is what came within the watermark's delay, a few numbers, and for intervals the starts that
are still open. Events later than the delay are left out. State needs the RocksDB store (``keyed_state``).
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType, TimestampType

#: Microseconds that timers are rounded up to, so that events close together share one.
TICK = 1_000_000


def keyed_state(spark: SparkSession) -> None:
    """Choose the state store that keyed state with timers needs, for queries that start from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Ordered(StatefulProcessor):
    """Holds a key's rows until the watermark has passed them, then takes them in order. ``_us`` is a row's time."""

    def __init__(self, schema: StructType, ties: list[str]):
        self.schema, self.names = schema, schema.names
        self.ties = [self.names.index(c) for c in ties]
        self.us = self.names.index("_us")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getListState("held", self.schema)

    def place(self, row: tuple) -> tuple:
        return row[self.us], *((row[k] is not None, row[k]) for k in self.ties)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        new = [tuple(r) for r in rows if r["_us"] > passed]
        if new:
            self.held.appendList(new)
            for tick in {-(-r[self.us] // TICK) for r in new}:
                self.handle.registerTimer(tick * TICK // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.held.exists():
            return
        passed, ready, rest = timerValues.getCurrentWatermarkInMs() * 1000, [], []
        for r in self.held.get():
            r = tuple(r)
            (ready if r[self.us] <= passed else rest).append(r)
        if not ready:
            return
        if rest:
            self.held.put(rest)
        else:
            self.held.clear()
        ready.sort(key=self.place)
        yield from self.take(key, ready)

    def take(self, key, rows: list[tuple]) -> Iterator[Row]:
        raise NotImplementedError

    def close(self) -> None:
        pass


class Runs(Ordered):
    """Numbers runs: a new one at each start marker, or after each longer gap."""

    def __init__(self, schema: StructType, marked: bool, gap_seconds: float):
        super().__init__(schema, [])
        self.marked, self.gap, self.event = marked, int(gap_seconds * 1_000_000), schema.names.index("event")
        self.out = Row(*(c for c in self.names if c != "_us"), "run")

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("run", StructType([StructField("run", IntegerType()), StructField("last", LongType())]))

    def take(self, key, rows: list[tuple]) -> Iterator[Row]:
        run, last = self.state.get() if self.state.exists() else (-1 if self.marked else 0, None)
        for us, same in itertools.groupby(rows, key=lambda r: r[self.us]):  # events of one time are in one run
            same = list(same)
            run += sum(r[self.event] == "run_start" for r in same) if self.marked else int(last is not None and us - last > self.gap)
            last = us
            if run >= 0:
                yield from (self.out(*(v for k, v in enumerate(r) if k != self.us), run) for r in same)
        self.state.update((run, last))


class Pairs(Ordered):
    """Pairs the k-th start with the k-th end. An end without its start is before it, and gives no interval."""

    def __init__(self, schema: StructType, by: list[str], start: str, end: str, ties: list[str], stamp):
        super().__init__(schema, ties)
        self.out = Row(*by, "k", "t0", "t1", "seconds", "bytes")
        self.start, self.end, self.stamp = start, end, stamp
        self.event, self.ts, self.bytes = (schema.names.index(c) for c in ("event", "ts", "bytes"))

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.counts = handle.getValueState("counts", StructType([StructField("starts", LongType()), StructField("ends", LongType())]))
        self.open = handle.getMapState("open", StructType([StructField("k", LongType())]), StructType([StructField("us", LongType()), StructField("ts", self.stamp), StructField("bytes", LongType())]))

    def take(self, key, rows: list[tuple]) -> Iterator[Row]:
        starts, ends = self.counts.get() if self.counts.exists() else (0, 0)
        for r in rows:
            us, ts, size = r[self.us], r[self.ts], r[self.bytes]
            if r[self.event] == self.start:
                starts += 1
                if starts > ends:
                    self.open.updateValue((starts,), (us, ts, size))
            elif r[self.event] == self.end:
                ends += 1
                if self.open.containsKey((ends,)):
                    us0, t0, size0 = self.open.getValue((ends,))
                    self.open.removeKey((ends,))
                    if us > us0:
                        yield self.out(*key, ends, t0, ts, round((us - us0) / 1e6, 6), size if size0 is None else size0)
        self.counts.update((starts, ends))


def _timed(events: DataFrame, late: str) -> DataFrame:
    """The watermark is on the time itself; ``_us`` is it in microseconds, for the state."""
    time = F.col("ts").cast("timestamp")
    return events.withColumn("_us", F.unix_micros(time)).withColumn("_time", time).withWatermark("_time", late)


def _keyed(events: DataFrame, by: list[str], late: str, processor, out: StructType) -> DataFrame:
    timed = _timed(events, late)
    return timed.groupBy(*by).transformWithState(processor(timed.schema), out, "Append", "EventTime")


def split_runs(events: DataFrame, by: list[str], marked: bool, gap_seconds: float = 300.0, late: str = "5 minutes") -> DataFrame:
    """A stream of events with ``run`` (from 0), as ``runlog.split_runs`` numbers them by ``by``.

    A stream can't know whether a marker is still to come, so ``marked`` says whether the logs have them; what comes before the first one belongs
    to no run and is left out.
    """
    out = StructType([*events.schema, StructField("_time", TimestampType()), StructField("run", IntegerType())])
    return _keyed(events, by, late, lambda schema: Runs(schema, marked, gap_seconds), out).drop("_time")


def intervals(events: DataFrame, by: list[str], start: str = "start", end: str = "done", ties: list[str] = ("bytes",), late: str = "5 minutes") -> DataFrame:
    """by, k, t0, t1, seconds, bytes of a stream of events, as ``runlog.intervals`` pairs them; an interval comes out once its end is past the watermark."""
    stamp, types = events.schema["ts"].dataType, {f.name: f for f in events.schema}
    out = StructType([*(types[c] for c in by), StructField("k", LongType()), StructField("t0", stamp), StructField("t1", stamp), StructField("seconds", DoubleType()), StructField("bytes", LongType())])
    some = events.where(F.col("event").isin(start, end))
    return _keyed(some, by, late, lambda schema: Pairs(schema, by, start, end, list(ties), stamp), out)
