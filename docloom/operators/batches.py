"""A batch of work that can stop anywhere and go on: a ledger with a result or an error for each file.

Files are dealt into slices by a hash of their path; a slice is one Spark job whose rows are committed together in
``attempt=A/slice=S`` of the ledger's folder. A run that starts again leaves out slices that are complete, so
each file is worked on once for each attempt. Errors that may pass (a rate limit) come again in the next
attempt, up to a bound; others are final at once. Rows that repeat a path are one file, with the greatest content.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.session import materialize

#: (path, content, attempt) to a result; what it raises is the file's error.
Work = Callable[[str, str, int], str]
_ROW = "path string, result string, error string"
_LEDGER = f"{_ROW}, attempt int, slice int"


def passing(error: Column) -> Column:
    """Whether an error may be gone the next time."""
    return F.lower(error).contains("rate") | error.contains("429")


def _done(spark: SparkSession, folder: str) -> set[tuple[int, int]]:
    """Complete slices of attempts."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/attempt=*/slice=*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    names = [str(x.getPath().getParent()).rsplit("/", 2)[1:] for x in found]
    return {(int(a.split("=")[1]), int(s.split("=")[1])) for a, s in names}


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """(path, result, error, attempt): each file's last attempt."""
    done = sorted(_done(spark, folder))
    if not done:
        return spark.createDataFrame([], "path string, result string, error string, attempt int")
    rows = spark.read.option("basePath", folder).schema(_LEDGER).parquet(*[f"{folder}/attempt={a}/slice={s}" for a, s in done])
    last = rows.groupBy("path").agg(F.max(F.struct("attempt", "result", "error")).alias("x"))
    return last.select("path", "x.result", "x.error", "x.attempt")


def run(files: DataFrame, work: Work, folder: str, slices: int = 16, attempts: int = 5, pause: Callable[[int], None] = lambda attempt: None) -> DataFrame:
    """Work on files (path, content) and return the ledger (path, result, error, attempt).

    ``pause`` is called before each further attempt, with its number. Null contents are empty texts; rows without path are left out.
    """
    spark = files.sparkSession
    own = files.where("path IS NOT NULL").groupBy("path").agg(F.coalesce(F.max("content"), F.lit("")).alias("content"))
    todo = materialize(own.withColumn("slice", F.pmod(F.xxhash64("path"), F.lit(slices)).cast("int")), "todo")
    for attempt in range(1, attempts + 1):
        rest = todo
        if attempt > 1:
            rest = materialize(todo.join(_may_pass(spark, folder, attempt - 1), "path", "left_semi"), "rest")
            if not rest.limit(1).count():
                break
            pause(attempt)

        def one(batches: Iterator[pa.RecordBatch], attempt: int = attempt) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for r in batch.to_pylist():
                    try:
                        out.append({"path": r["path"], "result": work(r["path"], r["content"], attempt), "error": None})
                    except Exception as e:  # noqa: BLE001  any error is the file's row
                        out.append({"path": r["path"], "result": None, "error": f"{type(e).__name__}: {e}"})
                yield pa.RecordBatch.from_pylist(out, pa.schema([("path", pa.string()), ("result", pa.string()), ("error", pa.string())]))

        complete = _done(spark, folder)
        for s in range(slices):
            if (attempt, s) not in complete:
                rest.where(F.col("slice") == s).select("path", "content").mapInArrow(one, _ROW).write.mode("overwrite").parquet(f"{folder}/attempt={attempt}/slice={s}")
    return ledger(spark, folder)


def _may_pass(spark: SparkSession, folder: str, attempt: int) -> DataFrame:
    """(path) of an attempt's files whose error may be gone the next time."""
    rows = spark.read.schema(_ROW).parquet(*[f"{folder}/attempt={attempt}/slice={s}" for a, s in sorted(_done(spark, folder)) if a == attempt])
    return rows.where(passing(F.col("error"))).select("path")


def report(done: DataFrame) -> DataFrame:
    """(files, succeeded, failed, retried) of a ledger."""
    return done.agg(F.count("*").alias("files"), F.count_if(F.col("error").isNull()).alias("succeeded"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.count_if(F.col("attempt") > 1).alias("retried"))
