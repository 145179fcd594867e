"""Change detection, checkpoints and the cache of model answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def changes(files: DataFrame, store: DataFrame) -> DataFrame:
    """(path, status) of files (path, sha256) against a store of the same shape: new, modified or deleted."""
    both = files.join(store.withColumnRenamed("sha256", "was"), "path", "full")
    status = F.when(F.col("was").isNull(), "new").when(F.col("sha256").isNull(), "deleted").when(F.col("sha256") != F.col("was"), "modified")
    return both.select("path", status.alias("status")).where("status IS NOT NULL")


def updated_store(store: DataFrame, done: DataFrame) -> DataFrame:
    """The store with the files that succeeded; others keep their old state and come again."""
    return store.join(done.select("path"), "path", "left_anti").unionByName(done.select("path", "sha256"))


def todo(files: DataFrame, completed: DataFrame) -> DataFrame:
    """Files that no checkpoint has."""
    return files.join(completed.select("path"), "path", "left_anti")


def stale(targets: DataFrame, sources: DataFrame) -> DataFrame:
    """Keys (key, mtime) whose target is missing or older than its source."""
    return sources.join(targets.withColumnRenamed("mtime", "made"), "key", "left").where("made IS NULL OR made < mtime").select("key")


def cache_key(model: Column, system: Column, user: Column) -> Column:
    return F.sha2(F.concat_ws("|", model, system, user), 256)


def lookup(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """(key, hit): requests against a cache, by key."""
    return requests.join(cache.select("key", F.lit(True).alias("hit")).distinct(), "key", "left").select("key", F.coalesce("hit", F.lit(False)).alias("hit"))


def complete(requests: DataFrame, cache: DataFrame, completion, schema_key: str = "key") -> DataFrame:
    """(key, response) of requests (key, prompt): from the cache, else by ``completion`` (a function of a list of prompts), once for each key."""
    missing = requests.join(cache.select("key"), "key", "left_anti").dropDuplicates(["key"]).select("key", "prompt")

    def run(batches):
        for pdf in batches:
            yield pdf[["key"]].assign(response=completion(pdf["prompt"].tolist()))

    made = missing.mapInPandas(run, "key string, response string")
    return cache.select("key", "response").join(requests.select("key").distinct(), "key", "left_semi").unionByName(made)


def cache_report(cache: DataFrame) -> DataFrame:
    """(entries, hits, kilobytes) of a cache (key, hit_count, response)."""
    return cache.agg(F.count("*").alias("entries"), F.coalesce(F.sum("hit_count"), F.lit(0)).alias("hits"), F.floor(F.coalesce(F.sum(F.octet_length("response")), F.lit(0)) / 1024).alias("kilobytes"))


def unexpired(cache: DataFrame, now: Column, days: int) -> DataFrame:
    """Entries younger than so many days; 0 days are for ever."""
    return cache if days == 0 else cache.where(F.col("created_at") >= now - F.make_dt_interval(F.lit(days)))
