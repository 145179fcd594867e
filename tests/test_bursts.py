"""Debounce by timers, in any order of arrival."""

from __future__ import annotations

import datetime as dt
import random

from docloom.session import scratch
from docloom.streaming import bursts


def by_hand(rows, gap):
    out, keys = [], {}
    for key, ts, path in rows:
        keys.setdefault(key, []).append((ts, path))
    for key, events in keys.items():
        now = None
        for ts, path in sorted(events, key=lambda e: e[0]):
            if now and (ts - now[1]).total_seconds() <= gap:
                now = (now[0], ts, now[2] + 1, now[3] | {path})
            else:
                out += [(key, *now)] if now else []
                now = (ts, ts, 1, {path})
        out.append((key, *now))
    return sorted((str(k), a, b, n, sorted(p - {None})) for k, a, b, n, p in out)


def test_bursts_of_files_in_any_order(spark):
    rng, start = random.Random(1), dt.datetime(2026, 1, 1)
    rows = [(rng.randint(0, 3), start + dt.timedelta(seconds=rng.randint(0, 40_000), microseconds=rng.randint(0, 999_999)), rng.choice(["a.md", "b.md", None])) for _ in range(400)]
    folder = scratch(spark, "events")
    for k in range(5):  # files that overlap in time
        spark.createDataFrame(rows[k::5], "key long, ts timestamp, path string").coalesce(1).write.mode("append").parquet(folder)
    spark.createDataFrame([(None, start, "x"), (1, None, "x")], "key long, ts timestamp, path string").write.mode("append").parquet(folder)
    stream = spark.readStream.schema("key long, ts timestamp, path string").option("maxFilesPerTrigger", 2).parquet(folder)
    at = lambda us: dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=us)
    got = sorted((r.key, at(r.start), at(r.last), r.n, r.paths) for r in bursts.debounced(stream, 120).collect())
    assert got == by_hand(rows, 120)


def test_what_ends_is_given_out_by_the_timer(spark):
    start = dt.datetime(2026, 1, 1)
    rows = [(1, start, "a"), (1, start + dt.timedelta(seconds=5), "b"), (1, start + dt.timedelta(days=3), "c"), (2, start + dt.timedelta(days=3), "d")]
    folder = scratch(spark, "events")
    spark.createDataFrame(rows, "key long, ts timestamp, path string").write.parquet(folder)
    out, state = scratch(spark, "out"), scratch(spark, "state")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = bursts.bursts(spark.readStream.schema("key long, ts timestamp, path string").parquet(folder), 10, late="1 hour")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        assert [(r.key, r.n, r.paths) for r in spark.read.parquet(out).collect()] == [("1", 2, ["a", "b"])]
        assert sorted((r.key, r.n, r.paths) for r in bursts.open_bursts(spark, state).collect()) == [("1", 1, ["c"]), ("2", 1, ["d"])]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
