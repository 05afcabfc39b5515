"""Event-time and stateful operators on streams.

Each keeps one small value a key and ends it by a timer on event time, once no row that may still come could be judged by it.
So state follows the keys that are alive, not all that ever were. Rows later than the watermark (``late``) are dropped by Spark. The state store has to be RocksDB: ``configure``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Added to event times, in milliseconds: streams begin with a watermark of 1970, and rows may be counted from 0.
SHIFT = 10**12


def configure(spark: SparkSession) -> SparkSession:
    """Choose the state store that timers and times to live need, for the streams that this session starts."""
    spark.conf.set(*PROVIDER)
    return spark


class Kept(StatefulProcessor):
    """One value a key. ``judge`` takes the value so far (None: none) and the rows in order, and gives the rows to put out, the value to
    keep, and when it ends in milliseconds of event time."""

    schema, columns, order = "", [], []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("kept", self.schema + ", until long")

    def judge(self, key, last: tuple | None, rows: pd.DataFrame) -> tuple[list[tuple], tuple, int]:
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = tuple(self.value.get()) if self.value.exists() else None
        out, kept, until = self.judge(key[0], None if last is None else last[:-1], pd.concat(list(rows)).sort_values(self.order))
        if last is None:
            self.handle.registerTimer(until + SHIFT)  # one timer a key: it looks again if the end has moved
        self.value.update((*kept, until + SHIFT))
        yield pd.DataFrame(out, columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = self.value.get()[-1] if self.value.exists() else None
        if until is not None and until > expiredTimerInfo.getExpiryTimeInMs():
            self.handle.registerTimer(until)
        else:
            self.value.clear()
        return iter([])

    def close(self) -> None:
        pass


def _run(rows: DataFrame, key: str, judge: Kept, out: str, at: Column, late: str) -> DataFrame:
    if rows.sparkSession.conf.get(PROVIDER[0]) != PROVIDER[1]:
        raise ValueError(f"timers need the RocksDB state store: call configure(spark), or set {PROVIDER[0]}")
    timed = rows.withColumn("_at", at).withWatermark("_at", late)
    return timed.groupBy(key).transformWithStateInPandas(judge, out, "append", "eventTime")


class Settled(Kept):
    schema, columns, order = "poll long, size long, mtime long, told boolean", ["name", "size", "mtime"], ["poll"]

    def __init__(self, forgotten: int):
        self.forgotten = forgotten

    def judge(self, key, last, rows):
        last, out = last or (-1, -1, -1, False), []
        for row in rows.itertuples():
            alike = (last[1], last[2]) == (row.size_, row.mtime)
            told = bool(last[3]) and alike
            if alike and not told and row.poll == last[0] + 1:
                out.append((key, row.size_, row.mtime))
                told = True
            last = (int(row.poll), int(row.size_), int(row.mtime), told)
        return out, last, (last[0] + self.forgotten) * 1000


def settled(polls: DataFrame, forgotten: int = 1000, late: int = 10) -> DataFrame:
    """``name, size, mtime`` of files that two consecutive polls found with the same size and time.
    ``polls`` has poll, name, size, mtime and is read in order of poll; a file is told of once for each state. Polls are the stream's time: a file that
    ``forgotten`` of them have not found is forgotten, and rows more than ``late`` polls behind are dropped."""
    named = polls.select("poll", "name", F.col("size").alias("size_"), "mtime")
    return _run(named, "name", Settled(forgotten), "name string, size long, mtime long", F.timestamp_millis(F.col("poll") * 1000 + SHIFT), f"{late} seconds")


class Limits(Kept):
    schema, columns, order = "start long, n long", ["key", "at", "blocked"], ["at"]

    def __init__(self, most: int, seconds: int):
        self.most, self.seconds = most, seconds

    def judge(self, key, last, rows):
        (start, n), out = last or (None, 0), []
        for at in map(int, rows["at"]):
            if start is None or at >= start + self.seconds:
                start, n = at, 0
            n += 1
            out.append((key, at, n > self.most))
        return out, (start, n), (start + self.seconds) * 1000


def limits(failures: DataFrame, most: int, seconds: int, late: str = "10 minutes") -> DataFrame:
    """``key, at, blocked``: a window starts with a key's first failure and lasts ``seconds``; failures
    beyond ``most`` in it are blocked. ``failures`` has key and at (epoch seconds). A window's count ends with it."""
    return _run(failures, "key", Limits(most, seconds), "key string, at long, blocked boolean", F.timestamp_millis(F.col("at") * 1000 + SHIFT), late)


class Sliding(Kept):
    schema, columns, order = "begin long, finish long", ["key", "at", "valid", "expires"], ["at"]

    def __init__(self, idle: int, longest: int, remembered: int):
        self.idle, self.longest, self.remembered = idle, longest, remembered

    def judge(self, key, last, rows):
        (begin, end), out = last or (None, 0), []
        for at in map(int, rows["at"]):
            if begin is None or at >= begin + self.longest + self.remembered:
                begin, end = at, min(at + self.idle, at + self.longest)
            valid = at < end
            if valid and end - at < self.idle / 2:
                end = min(at + self.idle, begin + self.longest)
            out.append((key, at, valid, end))
        return out, (begin, end), (begin + self.longest + self.remembered) * 1000


def slid_sessions(touches: DataFrame, idle: int, longest: int, remembered: int | None = None, late: str = "10 minutes") -> DataFrame:
    """``key, at, valid, expires``: a session opens at the first touch; a touch slides its end to ``idle``
    seconds on only when less than half is left, never beyond ``longest`` from its start. A touch after the
    end is invalid. ``touches`` has key and at (epoch seconds). An ended session is remembered for ``remembered`` seconds (``longest`` unless given) after its
    last possible end; then its key is free, and a touch opens a new one."""
    return _run(touches, "key", Sliding(idle, longest, longest if remembered is None else remembered), "key string, at long, valid boolean, expires long", F.timestamp_millis(F.col("at") * 1000 + SHIFT), late)


class Throttled(Kept):
    schema, columns, order = "last long", ["job", "at_ms", "done", "total"], ["at_ms", "done"]

    def __init__(self, every_ms: int):
        self.every_ms = every_ms

    def judge(self, key, last, rows):
        last, out = last[0] if last else -(10**15), []
        for row in rows.itertuples():
            if row.at_ms - last >= self.every_ms or row.done >= row.total:
                out.append((key, row.at_ms, row.done, row.total))
                last = int(row.at_ms)
        return out, (last,), last + self.every_ms


def throttled(progress: DataFrame, every_ms: int = 400, late: str = "10 seconds") -> DataFrame:
    """Progress rows (job, at_ms, done, total) that are at least ``every_ms`` after the last one let
    through, and final ones always. A job is kept until the next row would pass in any case."""
    return _run(progress, "job", Throttled(every_ms), "job string, at_ms long, done long, total long", F.timestamp_millis(F.col("at_ms") + SHIFT), late)


def windowed_counts(events: DataFrame, at: str, late: str, window: str, slide: str | None = None, by: str = "event_type") -> DataFrame:
    """Events by window of event time; rows later than ``late`` are left out, as their windows are closed.
    An extension."""
    framed = F.window(at, window, slide) if slide else F.window(at, window)
    counts = events.withWatermark(at, late).groupBy(framed.alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def last_states(log: DataFrame, at: str, late: str) -> DataFrame:
    """Jobs' live entries, one for each dedupe key within the watermark."""
    return log.withWatermark(at, late).dropDuplicatesWithinWatermark(["dedupe_key"])
