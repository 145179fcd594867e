"""What follows each batch of compiled pages: the index, the edges and the log, each idempotent by the batch's number.

A batch that is repeated after a failure writes the same tables again: ``pages`` and ``edges`` and ``log`` have a folder
for each batch, which is overwritten, and the index makes one update for each batch, so
it knows which it has.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import index
from docloom.operators.links import links
from docloom.session import scratch


@dataclass(frozen=True)
class Steps:
    """The steps' tables in a folder."""

    spark: SparkSession
    folder: str

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(f"{schema}, batch long").parquet(f"{self.folder}/{name}")

    def index(self) -> index.Index:
        return index.Index(self.spark, f"{self.folder}/index")

    def pages(self) -> DataFrame:
        """(slug, batch): the last batch of each page."""
        return self._read("pages", "slug string").groupBy("slug").agg(F.max("batch").alias("batch"))

    def edges(self) -> DataFrame:
        """(slug, pos, target): the links of each page as it was in its last batch."""
        return self._read("edges", "slug string, pos int, target string").join(self.pages(), ["slug", "batch"], "left_semi").select("slug", "pos", "target")

    def log(self) -> DataFrame:
        """(batch, n_pages, n_edges)."""
        return self._read("log", "n_pages long, n_edges long").select("batch", "n_pages", "n_edges")


def after(steps: Steps, pages: DataFrame, batch: int) -> None:
    """Do the steps for a batch of pages (doc_id, slug, content); of a page that is there several times the greatest content counts."""
    own = pages.groupBy("doc_id", "slug").agg(F.max("content").alias("content")).persist()
    found = links(own).select("slug", "pos", "target")
    own.select("slug").write.mode("overwrite").parquet(f"{steps.folder}/pages/batch={batch}")
    found.write.mode("overwrite").parquet(f"{steps.folder}/edges/batch={batch}")
    if steps.index().version() <= batch:  # update b + 1 is batch b's
        index.update(steps.index(), own.select("doc_id", F.col("content").alias("text")))
    own.agg(F.count("*").alias("n_pages")).crossJoin(found.agg(F.count("*").alias("n_edges"))).write.mode("overwrite").parquet(f"{steps.folder}/log/batch={batch}")  # one row each
    own.unpersist()


def run(stream: DataFrame, folder: str | None = None, state: str | None = None) -> Steps:
    """Do the steps for each batch of a stream of pages until there is nothing more."""
    spark = stream.sparkSession
    steps = Steps(spark, folder or scratch(spark, "steps"))
    query = stream.writeStream.foreachBatch(lambda rows, n: after(steps, rows, n)).option("checkpointLocation", state or scratch(spark, "steps-state")).trigger(availableNow=True).start()
    query.awaitTermination()
    return steps
