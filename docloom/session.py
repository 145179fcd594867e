"""Sessions, the given tables, the shared folder and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOT: dict[str, str] = {}
_WITHIN: ContextVar[str | None] = ContextVar("within", default=None)


def local_session(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("docloom")
    conf = {
        "spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g",
    }
    return builder.config(map=conf).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a temporary folder serves, but only for a local master.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if sc.applicationId not in _LOCAL_ROOT:
        _LOCAL_ROOT[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="docloom-")
    return _LOCAL_ROOT[sc.applicationId]


def scratch(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nobody has used."""
    return f"{_WITHIN.get() or shared_root(spark) + '/docloom'}/{label}-{uuid.uuid4().hex}"


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """What is written to scratch paths within goes at the end; results that are to stay are written to a path taken before."""
    folder = scratch(spark, "temporary")
    token = _WITHIN.set(folder)
    try:
        yield
    finally:
        _WITHIN.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it again, so that nothing before it is computed twice or lost with an executor."""
    spark = df.sparkSession
    path = path or scratch(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
