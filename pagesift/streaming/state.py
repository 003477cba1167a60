"""State for each key of a stream that ends: timers by event time forget a key once nothing came for ``idle``.

A key's timer stands at its newest event plus ``idle`` and moves with it; when the watermark passes the timer, a last row
with ``ended`` tells what the key amounted to, and its state is removed. A key that comes back begins anew. State
that is held by processing time instead expires by the store's own time to live.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_timers(spark: SparkSession) -> None:
    """Timers and times to live need the state store that holds columns by name; the session's streams use it from now on."""
    if "RocksDB" not in spark.conf.get(PROVIDER, ""):
        spark.conf.set(PROVIDER, ROCKS)


class Ending(StatefulProcessor):
    """The part that all such processors share: a value state and one timer for each key."""

    #: DDL of the state, and what it is before the first event.
    schema, empty = "", ()

    def __init__(self, idle_ms: int):
        self.idle = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", self.schema)
        self.ends = handle.getValueState("ends", "at long")

    def told(self, key: tuple, state: tuple, ended: bool) -> pd.DataFrame:
        raise NotImplementedError

    def after(self, state: tuple, rows: Iterator[pd.DataFrame]) -> tuple[tuple, int]:
        """The state after the rows, and the time of the newest in milliseconds."""
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues):
        state, newest = self.after(self.held.get() if self.held.exists() else self.empty, rows)
        self.held.update(state)
        before = self.ends.get()[0] if self.ends.exists() else None
        # Not in the past, or the timer would never go off.
        end = max(newest + self.idle, timerValues.getCurrentWatermarkInMs() + 1, before or 0)
        if end != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(end)
            self.ends.update((end,))
        yield self.told(key, state, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.held.exists():
            yield self.told(key, self.held.get(), True)
        self.held.clear()
        self.ends.clear()

    def close(self) -> None:
        pass


def _millis(times: pd.Series) -> pd.Series:
    return times.map(pd.Timestamp.timestamp) * 1000


class Bucket(Ending):
    schema, empty = "level double, last double, events long, refused long", (0.0, 0.0, 0, 0)

    def __init__(self, by: str, at: str, per_second: float, burst: float, idle_ms: int):
        super().__init__(idle_ms)
        self.by, self.at, self.rate, self.burst = by, at, per_second, burst

    def after(self, state, rows):
        level, last, events, refused = state
        times = pd.concat([_millis(b[self.at]) for b in rows]).sort_values().to_numpy() / 1000
        for t in times.tolist():
            level, last = max(0.0, level - max(0.0, t - last) * self.rate), max(last, t)
            events += 1
            if level + 1 <= self.burst:
                level += 1
            else:
                refused += 1
        return (level, last, events, refused), int(last * 1000)

    def told(self, key, state, ended):
        return pd.DataFrame({self.by: [key[0]], "events": [state[2]], "refused": [state[3]], "level": [max(0.0, state[0] - self.idle / 1000 * self.rate) if ended else state[0]], "ended": [ended]})


def bucket_states(stream: DataFrame, by: str, at: str, per_second: float, burst: float, watermark: str = "1 hour", idle: str = "1 day") -> DataFrame:
    """(by, events, refused, level, ended): a bucket for each key that leaks ``per_second`` and takes 1 with each event while it
    has room for it; an event beyond ``burst`` is refused. Events of a micro-batch are taken in the order of their
    times; one older than the watermark is late and dropped. ``idle`` without an event ends the key."""
    with_timers(stream.sparkSession)
    timed = stream.withWatermark(at, watermark)
    processor = Bucket(by, at, per_second, burst, _duration(idle))
    schema = f"`{by}` {dict(stream.dtypes)[by]}, events long, refused long, level double, ended boolean"
    return timed.groupBy(by).transformWithStateInPandas(processor, schema, "Update", "EventTime")


class Run(Ending):
    schema, empty = "events long, pages long, newest long", (0, 0, 0)

    def __init__(self, run: str, kind: str, at: str, idle_ms: int):
        super().__init__(idle_ms)
        self.run, self.kind, self.at = run, kind, at

    def after(self, state, rows):
        events, pages, newest = state
        for b in rows:
            events, pages, newest = events + len(b), pages + int((b[self.kind] == "view").sum()), max(newest, int(_millis(b[self.at]).max()))
        return (events, pages, newest), newest

    def told(self, key, state, ended):
        return pd.DataFrame({self.run: [key[0]], "events": [state[0]], "pages": [state[1]], "ended": [ended]})


def running_state(stream: DataFrame, run: str, kind: str, at: str, watermark: str = "1 hour", idle: str = "1 day") -> DataFrame:
    """(run, events, pages, ended) of a stream of events, updated with each batch; state per run is three numbers."""
    with_timers(stream.sparkSession)
    schema = f"`{run}` {dict(stream.dtypes)[run]}, events long, pages long, ended boolean"
    return stream.withWatermark(at, watermark).groupBy(run).transformWithStateInPandas(Run(run, kind, at, _duration(idle)), schema, "Update", "EventTime")


class Seen(StatefulProcessor):
    """The first row of a key passes; the store forgets the key ``ttl_ms`` after, by processing time."""

    def __init__(self, columns: list[str], ttl_ms: int):
        self.columns, self.ttl = columns, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "yes boolean", self.ttl)

    def handleInputRows(self, key, rows, timerValues):
        passed = self.seen.exists()
        for b in rows:
            if not passed and len(b):
                self.seen.update((True,))
                passed = True
                yield b[self.columns].head(1)

    def close(self) -> None:
        pass


def once_within(stream: DataFrame, keys: list[str], ttl: str) -> DataFrame:
    """One row for each key until ``ttl`` has gone by since, on the clock: what was seen longer ago passes again.
    As time goes by without data, such a stream never ends by itself; stop it, or let a trigger by time run it."""
    with_timers(stream.sparkSession)
    schema = ", ".join(f"`{n}` {t}" for n, t in stream.dtypes)
    return stream.groupBy(*keys).transformWithStateInPandas(Seen(stream.columns, _duration(ttl)), schema, "Append", "ProcessingTime")


def _duration(text: str) -> int:
    """Milliseconds of an interval such as "90 seconds"."""
    return int(pd.Timedelta(text).total_seconds() * 1000)


def collected(updates: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs a stream in update mode over all that is there now, each micro-batch into a folder of its own, and reads all updates
    back. A micro-batch that runs again replaces what it wrote before."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    updates.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start().awaitTermination()
    return updates.sparkSession.read.schema(updates.schema.add("batch", "long")).option("basePath", path).parquet(f"{path}/batch=*")


def kept_last(updates: DataFrame, key: str) -> DataFrame:
    """Of a key's updates the last: what the stream amounts to so far."""
    names = [c for c in updates.columns if c != "batch"]
    return updates.groupBy(key).agg(F.max_by(F.struct(*names), F.struct("batch", "ended")).alias("u")).select("u.*")
