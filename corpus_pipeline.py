"""A corpus pipeline: each stage takes the documents that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import decontam, mixing, neardup, tokens, toxicity
from docloom.llm.common import materialize, small_or_none, table
from docloom.llm.queries import TOKENS
from docloom.session import scratch, temporary

#: Up to so many ids of dropped documents are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Documents whose id isn't among the given ones (_gone)."""
    ids = small_or_none(materialize(gone.distinct(), "gone"), BROADCAST_IDS)
    return docs.join(ids, docs["doc_id"].cast("long") == ids["_gone"], "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labelled ones outside the held-out fold."""
    model = toxicity.trained(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays.

    Rows that repeat a doc_id are versions of one document: one with the kept
    document's id stays (the least text). Rows without doc_id stay.
    """
    found = materialize(neardup.near_duplicates(docs), "found")
    left = _without(docs, found.where(~F.col("kept")).select(F.col("doc_id").alias("_gone")))
    again = materialize(found.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_again")), "again")
    if again.limit(1).count() == 0:
        return left
    same = left["doc_id"].cast("long") == again["_again"]
    one = left.join(again, same, "left_semi").groupBy("doc_id").agg(F.min(F.struct("text", *[c for c in docs.columns if c not in ("doc_id", "text")])).alias("_one"))
    return left.join(again, same, "left_anti").unionByName(one.select("doc_id", "_one.*").select(*docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    hit = decontam.contamination(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, hit.where("n_hit > 0 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_gone")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken, and repeated, until each source has its target of words."""
    return mixing.mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files' contents: doc_id, start, n_tokens and ids_crc32 of each document."""
    return tokens.read_shards(tokens.write_shards(docs, TOKENS))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("tokens", write_tokens),
]

#: The first stages train a classifier and search near-duplicates; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written as Parquet and read again, and what else a stage wrote goes."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, name)
        with temporary(spark):
            docs = materialize(stage(spark, docs, sf_dir), name, path)
    return docs
