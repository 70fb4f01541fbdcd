"""Streams with keyed state: a sliding limit and a bounded log, whose state survives restarts in the checkpoint.

`limited` gives each event what the batch of the same name gives it: events of a user wait in state until the watermark has
passed them, so that late ones take their place in order; events older than the watermark are dropped by Spark. A user's
state is what waits and the times of the last window.

`logged` appends events to streams: each gets the next number of its stream; a stream keeps its last `length` events and is
emptied when nothing came for `ttl` seconds of event time, by a timer. What is given out are changes (append, trim with the
number up to which events are gone, expire), from which `live` reads a log after any number.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LIMITED = "event_id long, user_id long, n long, wait double"
CHANGES = "stream long, change string, offset long, event_id long, event string, ts_us long"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """While a query with state starts, the session's state store is the one that keyed state needs."""
    was = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(STORE, was)


class Ordered(StatefulProcessor):
    """Events of a key wait until the watermark has passed them, then come in order of time and id. Those of a batch wait
    in one row of state, as JSON: a row of state for each event costs a call of the store for each."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows string")

    def rows_of(self, frame: pd.DataFrame) -> list[tuple]:
        return list(zip(frame["at"].astype("int64").tolist(), frame["event_id"].astype("int64").tolist(), strict=True))

    def handleInputRows(self, key, rows, timerValues):
        new = [r for frame in rows for r in self.rows_of(frame)]
        self.waiting.appendValue((json.dumps(new),))
        self.wake(new)
        return iter([])

    def wake(self, rows: list[tuple]) -> None:
        """A timer for the first of the rows; when it has passed, the first that is left gets one. So a key has a timer for
        each batch that brings it events, not for each event."""
        self.handle.registerTimer(min(rows)[0] // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(tuple(r) for (rows,) in self.waiting.get() for r in json.loads(rows))
        due = [r for r in held if r[0] <= passed]
        if due:
            if len(due) < len(held):
                self.waiting.put([(json.dumps(held[len(due) :]),)])
                self.wake(held[len(due) :])
            else:
                self.waiting.clear()
            yield from self.ordered(key, due)

    def ordered(self, key, due: list[tuple]) -> Iterator[pd.DataFrame]:
        raise NotImplementedError

    def close(self) -> None:
        pass


class Limiter(Ordered):
    def __init__(self, limit: int, seconds: int):
        self.limit, self.span = limit, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.times = handle.getValueState("times", "at string")

    def ordered(self, key, due):
        """Like the batch: n counts the events of the last seconds up to the same instant; the wait is until the event
        `limit` places before is old enough."""
        times = json.loads((self.times.get() or ("[]",))[0])
        start, out = len(times), []
        times += [at for at, _ in due]
        low = high = 0
        for i, (at, event) in enumerate(due):
            while times[low] <= at - self.span:
                low += 1
            high = max(high, start + i)
            while high < len(times) and times[high] == at:
                high += 1
            n, place = high - low, start + i
            wait = (times[place - self.limit] + self.span - at) / 1e6 if place >= self.limit else 0.0
            out.append((event, key[0], n, wait if n > self.limit and wait > 0 else None))
        last = times[-1]
        keep = max(0, min(len(times) - self.limit, next(i for i, t in enumerate(times) if t > last - self.span)))
        self.times.update((json.dumps(times[keep:]),))
        columns = zip(("event_id", "user_id", "n", "wait"), zip(*out, strict=True), ("int64", "int64", "int64", "float64"), strict=True)
        yield pd.DataFrame({name: np.array(values, kind) for name, values, kind in columns})


class Log(Ordered):
    def __init__(self, length: int, ttl: int):
        self.length, self.ttl = length, ttl * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("log", "next long, first long, last_at long")

    def rows_of(self, frame):
        return list(zip(frame["at"].astype("int64").tolist(), frame["event_id"].astype("int64").tolist(), frame["event"].tolist(), strict=True))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from super().handleExpiredTimer(key, timerValues, expiredTimerInfo)
        next_, first, last = self.state.get() or (1, 1, 0)
        if first < next_ and timerValues.getCurrentWatermarkInMs() * 1000 >= last + self.ttl:
            self.state.update((next_, next_, last))
            yield self.changes([(key[0], "expire", next_ - 1, None, None, last + self.ttl)])

    def ordered(self, key, due):
        next_, first, last = self.state.get() or (1, 1, 0)
        out = []
        for at, id_, event in due:
            if first < next_ and at >= last + self.ttl:
                out.append((key[0], "expire", next_ - 1, None, None, last + self.ttl))
                first = next_
            out.append((key[0], "append", next_, id_, event, at))
            next_, last = next_ + 1, at
            if next_ - first > self.length:
                first = next_ - self.length
                out.append((key[0], "trim", first - 1, None, None, at))
        self.state.update((next_, first, last))
        self.handle.registerTimer((last + self.ttl) // 1000 + 1)
        yield self.changes(out)

    @staticmethod
    def changes(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["stream", "change", "offset", "event_id", "event", "ts_us"]).astype({"event_id": "Int64"})


def timed(events: DataFrame, late: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return events.withColumns({"ts": ts, "at": F.unix_micros(ts)}).withWatermark("ts", late)


def limited(events: DataFrame, limit: int, seconds: int, late: str = "1 hour") -> DataFrame:
    """(event_id, user_id, n, wait) of a streaming frame (event_id, user_id, ts); needs `keyed_state` when it starts."""
    e = timed(events.select("event_id", "user_id", "ts"), late)
    return e.groupBy("user_id").transformWithStateInPandas(Limiter(limit, seconds), LIMITED, "append", "eventtime")


def logged(events: DataFrame, stream: str, event: str, length: int, ttl: int, late: str = "1 hour") -> DataFrame:
    """The changes of the logs of a streaming frame with event_id and ts, a log for each value of `stream`."""
    e = timed(events.select(F.col(stream).alias("stream"), "event_id", "ts", F.col(event).alias("event")), late)
    return e.groupBy("stream").transformWithStateInPandas(Log(length, ttl), CHANGES, "append", "eventtime")


def live(changes: DataFrame, after: int = 0) -> DataFrame:
    """(stream, offset, event_id, event, ts_us) of what the logs hold after a number, from their changes."""
    gone = changes.where("change <> 'append'").groupBy("stream").agg(F.max("offset").alias("__gone"))
    rows = changes.where((F.col("change") == "append") & (F.col("offset") > after)).drop("change")
    return rows.join(gone, "stream", "left").where(F.col("offset") > F.coalesce("__gone", F.lit(0))).drop("__gone")


def log_of(events: DataFrame, stream: str, event: str, length: int, ttl: int) -> DataFrame:
    """What `live` gives after all events have passed, of a batch: the last `length` events of each stream since the last
    gap of `ttl` seconds."""
    w = Window.partitionBy("stream").orderBy("ts_us", "event_id")
    e = events.select(F.col(stream).alias("stream"), "event_id", F.col(event).alias("event"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"))
    e = e.withColumns({"offset": F.row_number().over(w).cast("long"), "gap": (F.col("ts_us") - F.lag("ts_us").over(w) >= ttl * 1_000_000).cast("int")})
    whole = Window.partitionBy("stream")
    e = e.withColumns({"last": F.max("offset").over(whole), "since": F.max(F.when(F.col("gap") == 1, F.col("offset"))).over(whole)})
    return e.where((F.col("offset") > F.col("last") - length) & (F.col("offset") >= F.coalesce("since", F.lit(0)))).select("stream", "offset", "event_id", "event", "ts_us")


def run_once(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Works off what there is, and adds the results to a table."""
    with keyed_state(stream.sparkSession):
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start().awaitTermination()
