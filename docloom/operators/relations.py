"""Typed relations between concepts, and groups of duplicate concepts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.components import components

#: The types, and those that have an inverse.
TYPES = ("parent", "child", "related", "conflict")
INVERSE = {"parent": "child", "child": "parent"}


def valid(relations: DataFrame, concepts: DataFrame) -> DataFrame:
    """Relations (seq, source, target, type) between known concepts (id), without self loops; unknown types are related."""
    known = concepts.select(F.col("id").cast("long").alias("id"))
    rows = relations.where("source <> target").join(known.withColumnRenamed("id", "source"), "source", "left_semi").join(known.withColumnRenamed("id", "target"), "target", "left_semi")
    return rows.select("seq", "source", "target", F.when(F.col("type").isin(*TYPES), F.col("type")).otherwise("related").alias("type"))


def first_of_pair(relations: DataFrame) -> DataFrame:
    """Of relations with the same ends in the same direction the first."""
    return relations.groupBy("source", "target").agg(F.min(F.struct("seq", "type")).alias("f")).select("f.seq", "source", "target", "f.type")


def with_inverses(relations: DataFrame) -> DataFrame:
    """Add the inverse of a relation that has one, where no relation of any type leads back."""
    back = relations.where(F.col("type").isin(*INVERSE)).select("seq", F.col("target").alias("source"), F.col("source").alias("target"), F.when(F.col("type") == "parent", "child").otherwise("parent").alias("type"))
    return relations.select("seq", "source", "target", "type").unionByName(back.join(relations.select("source", "target"), ["source", "target"], "left_anti"))


def outgoing(relations: DataFrame) -> DataFrame:
    """(source, relations): type:target of each source in order."""
    return relations.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("type", "target"))), lambda x: F.concat_ws(":", x["type"], x["target"].cast("string"))), ",").alias("relations"))


def batches(concepts: DataFrame, size: int = 30) -> DataFrame:
    """(batch, n, first, last) of concepts in order of slug, in batches of a size.

    Positions come from counts of slug prefixes, so that no task orders all of them.
    """
    rows = concepts.select("slug", F.substring("slug", 1, 3).alias("shard"))
    counts = rows.groupBy("shard").agg(F.count("*").alias("n"))
    before = counts.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    at = F.col("before") + F.row_number().over(Window.partitionBy("shard").orderBy("slug")) - 1
    placed = rows.join(before, "shard").select("slug", F.floor(at / size).alias("batch"))
    return placed.groupBy("batch").agg(F.count("*").alias("n"), F.min("slug").alias("first"), F.max("slug").alias("last"))


def merged_groups(groups: DataFrame) -> DataFrame:
    """(canonical, n, members) of groups (gid, canonical, member) that are one where they share a member; the least group names it."""
    links = groups.select(F.concat(F.lit("g"), "gid").alias("a"), F.concat(F.lit("m"), "member").alias("b"))
    found = components(links)
    own = groups.withColumn("node", F.concat(F.lit("g"), "gid")).join(found, "node")
    return own.groupBy("component").agg(F.min(F.struct("gid", "canonical")).alias("c"), F.array_sort(F.collect_set("member")).alias("m")).where(F.size("m") > 1).select(F.col("c.canonical").alias("canonical"), F.size("m").cast("long").alias("n"), F.array_join("m", ",").alias("members"))


def canonical_pages(groups: DataFrame, pages: DataFrame) -> DataFrame:
    """(gid, chosen): of each group the page (name, content) with the canonical name, else the longest, else the first by name."""
    rows = groups.join(pages.select(F.col("name").alias("member"), F.length("content").alias("size")), "member")
    return rows.groupBy("gid").agg(F.min(F.struct((F.col("member") != F.col("canonical")).alias("other"), (-F.col("size")).alias("order"), "member")).alias("best")).select("gid", F.col("best.member").alias("chosen"))
