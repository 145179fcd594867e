"""Bursts of a watched folder's events, debounced by a timer for each key.

A key's burst grows while events come within a pause of each other; its timer is
set anew by each batch, and when it runs out the burst is given out with the distinct paths it saw. What is still open when a
stream ends stays in its state, from where ``open_bursts`` reads it; nothing must arrive to close it.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from docloom.session import scratch

_STATE = "open array<struct<start:long,last:long,n:long,paths:array<string>>>"
_OUT = "key string, start long, last long, n long, paths array<string>"


class Debounce(StatefulProcessor):
    """A key's open bursts, apart by more than ``gap`` microseconds; events may come in any order that the watermark allows.

    A batch's events are taken one by one, so only bursts are held, not events.
    """

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("bursts", _STATE)

    def _open(self) -> list[list]:
        return [[b[0], b[1], b[2], set(b[3])] for b in self.state.get()[0]] if self.state.exists() else []

    def _keep(self, held: list[list]) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if held:
            self.state.update(([(a, b, n, sorted(paths)) for a, b, n, paths in held],))
            self.handle.registerTimer((min(b[1] for b in held) + self.gap) // 1000 + 1)
        else:
            self.state.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self._open()
        for r in rows:
            at, paths = r["at"], set() if r["path"] is None else {r["path"]}
            k = bisect_right(held, at, key=lambda b: b[0])
            joined = [b for b in held[max(0, k - 1) : k + 1] if b[0] - self.gap <= at <= b[1] + self.gap]
            low = min([at, *(b[0] for b in joined)])
            one = [low, max([at, *(b[1] for b in joined)]), 1 + sum(b[2] for b in joined), paths.union(*(b[3] for b in joined))]
            held = [b for b in held if b not in joined] if joined else held
            insort(held, one, key=lambda b: b[0])
        self._keep(held)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now, held = expiredTimerInfo.getExpiryTimeInMs() * 1000, self._open()
        over = [b for b in held if b[1] + self.gap < now]
        self._keep([b for b in held if b[1] + self.gap >= now])
        for start, last, n, paths in over:
            yield Row(key=key[0], start=start, last=last, n=n, paths=sorted(paths))

    def close(self) -> None:
        pass


def bursts(events: DataFrame, gap_seconds: float, late: str = "1 day") -> DataFrame:
    """(key, start, last, n, paths) of a stream (ts, key, path): bursts that ended, in microseconds."""
    own = events.where("ts IS NOT NULL AND key IS NOT NULL").withWatermark("ts", late).select("ts", F.col("key").cast("string").alias("key"), F.col("path").cast("string").alias("path"), F.unix_micros("ts").alias("at"))
    return own.groupBy("key").transformWithState(Debounce(int(gap_seconds * 1e6)), _OUT, "Append", "EventTime")


def open_bursts(spark, state: str) -> DataFrame:
    """(key, start, last, n, paths) of what a stream's state still holds."""
    rows = spark.read.format("statestore").option("stateVarName", "bursts").load(state)
    return rows.select("key.key", F.explode("value.open").alias("b")).select("key", "b.*")


def debounced(events: DataFrame, gap_seconds: float, late: str = "1 day") -> DataFrame:
    """All bursts of a stream that is at its end for now: those that ended, and those that are open."""
    spark = events.sparkSession
    out, state = scratch(spark, "bursts"), scratch(spark, "bursts-state")
    name = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        bursts(events, gap_seconds, late).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(_OUT).parquet(out).unionByName(open_bursts(spark, state))
    finally:
        spark.conf.set(name, was)
