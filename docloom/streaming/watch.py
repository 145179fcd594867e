"""A watched folder: changes arrive as files, bursts are debounced, and each batch maintains the store."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.incremental import changes
from docloom.session import scratch


def debounced(events: DataFrame, gap: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """(key, start, end, n): bursts of a stream (ts, key); a burst ends after a pause of ``gap``."""
    return events.withWatermark("ts", late).groupBy("key", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("key", "w.start", "w.end", "n")


def counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, action, n): a log's tumbling counts."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "action").agg(F.count("*").alias("n")).select("w.start", "action", "n")


def replayed(log: DataFrame, plan: Callable[[DataFrame], DataFrame], label: str, rows: int = 5_000_000) -> DataFrame:
    """What a streaming plan gives over the whole of a log (ts, ...).

    The log is written once, a folder for each arrival of about so many rows in order of time; folders
    are moved to the watched one, one after the other. All files of an arrival
    are one batch, so the watermark never passes rows that are still to come,
    whatever the order of files. A last row 100 years on, with nulls else, closes
    what is open; its own window stays open and isn't written. Rows without ts
    are in no window.
    """
    spark, log = log.sparkSession, log.where("ts IS NOT NULL")
    parts = max(1, math.ceil(log.count() / rows))
    at = log.select(F.percentile_approx(F.unix_micros("ts"), [k / parts for k in range(1, parts)], 10_000).alias("at")).first()["at"] if parts > 1 else []
    edges = sorted(set(at or []))
    end = log.agg(F.max("ts").alias("ts")).select(*[F.expr("ts + INTERVAL 100 YEARS").alias(c) if c == "ts" else F.lit(None).cast(log.schema[c].dataType).alias(c) for c in log.columns])
    staged, folder, out, state = scratch(spark, f"{label}-staged"), scratch(spark, f"{label}-log"), scratch(spark, label), scratch(spark, f"{label}-state")
    arrival = F.size(F.filter(F.lit(edges).cast("array<bigint>"), lambda e: e <= F.unix_micros("ts")))
    log.withColumn("_arrival", arrival).repartition("_arrival", F.pmod(F.xxhash64("ts"), F.lit(8))).write.partitionBy("_arrival").parquet(staged)
    end.write.parquet(f"{staged}/_arrival={len(edges) + 1}")
    path = lambda name: spark._jvm.org.apache.hadoop.fs.Path(name)
    fs = path(staged).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path(folder))
    for k in range(len(edges) + 2):
        if fs.exists(path(f"{staged}/_arrival={k}")):
            fs.rename(path(f"{staged}/_arrival={k}"), path(f"{folder}/arrival-{k}"))
        stream = plan(spark.readStream.schema(log.schema).option("recursiveFileLookup", True).parquet(folder))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def drained(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Run a streaming query over all that is there and return what it has written."""
    spark = stream.sparkSession
    out = scratch(spark, label)
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark, f"{label}-state")).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def watch(files: DataFrame, store: DataFrame, sink: Callable[[DataFrame, int], None]) -> None:
    """For each batch of a stream of files (path, sha256), hand the new and modified ones to a sink."""

    def batch(rows: DataFrame, n: int) -> None:
        found = changes(rows.groupBy("path").agg(F.max("sha256").alias("sha256")), store).where("status <> 'deleted'")
        sink(found, n)

    files.writeStream.foreachBatch(batch).option("checkpointLocation", scratch(files.sparkSession, "watch-state")).trigger(availableNow=True).start().awaitTermination()


def watched(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table's folder as a stream of its files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(path)


def as_folder(df: DataFrame, label: str) -> str:
    """A table as a folder of Parquet files, which a stream can watch."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return path
