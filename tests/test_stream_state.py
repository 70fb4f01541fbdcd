"""Keyed state of streams: the batch's rows, late events, and a restart in the middle."""

from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from lucerna.streaming import events as E
from lucerna.streaming import state as ST

SCHEMA = "event_id long, user_id long, ts timestamp_ntz, kind string"


def test_restart_gives_the_rows_of_the_batch(spark, tmp_path):
    """Three runs with one checkpoint: out of order within the delay, ties, a user that comes back; the last run's far
    event lets the watermark pass all."""
    began = datetime(2024, 1, 1)
    rows = [(k, k % 3, began + timedelta(seconds=(k * 37) % 600 + 600 * (k // 20)), f"k{k % 4}") for k in range(120)] + [(500 + k, 7, began + timedelta(seconds=1000), "tie") for k in range(4)]
    late = [(900, 1, began + timedelta(seconds=2000), "late")]
    first, second = [r for r in rows if r[2] < began + timedelta(seconds=2100)], [r for r in rows if r[2] >= began + timedelta(seconds=2100)] + late
    source, out, log = str(tmp_path / "in"), {}, {}
    runs = [first, second, [(9999, -1, datetime(2100, 1, 1), "end")]]
    for k, part in enumerate(runs):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        ST.run_once(ST.limited(stream, 2, 300, "20 minutes"), str(tmp_path / "out"), str(tmp_path / "c1"))
        ST.run_once(ST.logged(stream, "user_id", "kind", 5, 400, "20 minutes"), str(tmp_path / "log"), str(tmp_path / "c2"))
        out[k] = spark.read.schema(ST.LIMITED).parquet(str(tmp_path / "out")).count()
        log[k] = spark.read.schema(ST.CHANGES).parquet(str(tmp_path / "log")).where("change = 'append'").count()
    assert 0 < out[0] < out[1] < out[2]
    batch = spark.createDataFrame(rows + late, SCHEMA)
    key = lambda df: sorted((r["event_id"], r["user_id"], r["n"], None if r["wait"] is None else round(r["wait"], 6)) for r in df.collect())
    assert key(spark.read.schema(ST.LIMITED).parquet(str(tmp_path / "out")).where("user_id >= 0")) == key(E.limited(batch, 2, 300))
    changes = spark.read.schema(ST.CHANGES).parquet(str(tmp_path / "log")).where("stream >= 0").cache()
    assert changes.where("change = 'append'").count() == len(rows) + 1 and changes.where("change = 'expire'").count() > 0
    tail = ST.log_of(batch, "user_id", "kind", 5, 400)
    shown = {(r["stream"], r["offset"], r["event_id"]) for r in ST.live(changes.where("change <> 'expire'")).collect()}
    assert {(r["stream"], r["offset"], r["event_id"]) for r in tail.collect()} <= shown
    assert ST.live(changes).count() == 0  # all streams have been silent for long
    after = {(r["stream"], r["offset"]) for r in ST.live(changes.where(F.col("change") == "append"), 10).collect()}
    assert after and min(o for _, o in after) == 11


class Store:
    """State of one key in plain Python: what is called, how often."""

    def __init__(self, calls):
        self.rows, self.calls = [], calls

    def note(self, name):
        self.calls[name] = self.calls.get(name, 0) + 1

    def appendValue(self, row):
        self.note("append")
        self.rows.append(row)

    def appendList(self, rows):
        self.calls["append"] = self.calls.get("append", 0) + len(rows)
        self.rows += rows

    def put(self, rows):
        self.rows = list(rows)

    def update(self, row):
        self.rows = [row]

    def clear(self):
        self.rows = []

    def exists(self):
        return bool(self.rows)


class Listed(Store):
    def get(self):
        self.note("get")
        return iter(self.rows)


class Valued(Store):
    def get(self):
        return self.rows[0] if self.rows else None


class Handle:
    def __init__(self):
        self.calls, self.timers = {}, set()

    def getListState(self, name, schema):
        return Listed(self.calls)

    def getValueState(self, name, schema):
        return Valued(self.calls)

    def registerTimer(self, at):
        self.calls["timer"] = self.calls.get("timer", 0) + 1
        self.timers.add(at)


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def worked_off(processor, batches, columns):
    """Each batch (watermark, rows) adds its rows, then the timers that the watermark has passed fire."""
    handle, out = Handle(), []
    processor.init(handle)
    for mark, rows in batches:
        if rows:
            assert list(processor.handleInputRows((7,), iter([pd.DataFrame(rows, columns=columns)]), Clock(mark))) == []
        for at in sorted(t for t in handle.timers if t <= mark):
            handle.timers.discard(at)
            out += [tuple(r) for frame in processor.handleExpiredTimer((7,), Clock(mark), None) for r in frame.itertuples(index=False)]
    return out, handle.calls


def test_calls_of_the_store_do_not_grow_with_the_events_of_a_key():
    """2,000 events of a key in two batches, passed in three steps: all come once, in order, with a few calls of the store."""
    ms = 1000
    rows = [(k * 50 * ms, k) for k in range(2000)]
    batches = [(0, rows[1::2]), (10_000, rows[::2]), (40_000, []), (200_000, [])]
    out, calls = worked_off(ST.Limiter(2, 1), batches, ["at", "event_id"])
    assert [r[0] for r in out] == list(range(2000)) and [r[2] for r in out[-3:]] == [20, 20, 20] and [r[2] for r in out[:3]] == [1, 2, 3]
    assert sum(calls.values()) < 30, calls


def test_log_of_a_key_with_few_calls_of_the_store():
    rows = [(k * 50_000, k, f"e{k}") for k in range(2000)]
    out, calls = worked_off(ST.Log(3, 3600), [(0, rows[1::2]), (10_000, rows[::2]), (40_000, []), (200_000, []), (9_000_000, [])], ["at", "event_id", "event"])
    kinds = [r[1] for r in out]
    assert [r[3] for r in out if r[1] == "append"] == list(range(2000)) and kinds.count("trim") == 1997 and kinds.count("expire") == 1
    assert sum(calls.values()) < 30, calls
