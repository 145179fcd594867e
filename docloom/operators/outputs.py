"""Models' answers to rows: statements, relations, groups, merges and conflicts. A broken answer gives nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import json_array, strip_fence
from docloom.operators.graph import PREDICATES
from docloom.operators.relations import TYPES

TRIPLE = "array<struct<subject:string,predicate:string,object:string,confidence:string,reason:string>>"
RELATION = "array<struct<source:string,target:string,type:string>>"
GROUP = "array<struct<canonical:string,members:array<string>>>"


def parse_triples(outputs: DataFrame) -> DataFrame:
    """(source, idx, pos, subject, predicate, object, confidence, reason) of answers (source, idx, output).

    Statements without all parts, or with an unknown predicate, are dropped; the
    confidence lies between 0 and 1 and is 0.7 where there is none.
    """
    rows = outputs.select("source", "idx", F.posexplode(F.from_json(json_array(F.col("output")), TRIPLE)).alias("pos", "t"))
    clean = lambda name: F.trim(F.coalesce(F.col(f"t.{name}"), F.lit("")))
    sure = F.round(F.least(F.greatest(F.coalesce(F.col("t.confidence").try_cast("double"), F.lit(0.7)), F.lit(0.0)), F.lit(1.0)), 2)
    rows = rows.select("source", "idx", "pos", clean("subject").alias("subject"), F.upper(clean("predicate")).alias("predicate"), clean("object").alias("object"), sure.alias("confidence"), clean("reason").alias("reason"))
    return rows.where((F.col("subject") != "") & (F.col("object") != "") & F.col("predicate").isin(*PREDICATES))


def parse_relations(outputs: DataFrame, concepts: DataFrame) -> DataFrame:
    """(batch, pos, source, target, type) of answers (batch, output): both ends are concepts (batch, slug) of the batch, none is its own; unknown types are related."""
    rows = outputs.select("batch", F.posexplode(F.from_json(json_array(F.col("output")), RELATION)).alias("pos", "r"))
    rows = rows.select("batch", "pos", F.trim("r.source").alias("source"), F.trim("r.target").alias("target"), F.lower("r.type").alias("type")).where("source <> target")
    for end in ("source", "target"):
        rows = rows.join(concepts.select("batch", F.col("slug").alias(end)), ["batch", end], "left_semi")
    return rows.select("batch", "pos", "source", "target", F.when(F.col("type").isin(*TYPES), F.col("type")).otherwise("related").alias("type"))


def parse_groups(outputs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(source, pos, canonical, members) of answers (source, output): groups with a name and two members at least, of those that are known (name), if given."""
    rows = outputs.select("source", F.posexplode(F.from_json(json_array(F.col("output")), GROUP)).alias("pos", "g"))
    members = F.filter(F.transform("g.members", lambda x: F.trim(x)), lambda x: x != "")
    rows = rows.select("source", "pos", F.trim("g.canonical").alias("canonical"), members.alias("members")).where((F.col("canonical") != "") & (F.size("members") >= 2))
    if known is None:
        return rows
    each = rows.select("source", "pos", "canonical", F.posexplode("members").alias("at", "name")).join(known.select("name").distinct(), "name", "left_semi")
    listed = each.groupBy("source", "pos", "canonical").agg(F.array_sort(F.collect_list(F.struct("at", "name"))).alias("m"))  # what one answer names
    return listed.where(F.size("m") >= 2).select("source", "pos", "canonical", F.transform("m", lambda x: x["name"]).alias("members"))


def merge_answer(output: Column) -> Column:
    """(action, content, conflict_summary) of a merge's answer: lines ACTION and CONFLICT_SUMMARY, then the page after a mark.

    The last known action counts, complement without one; an answer that
    complements without the mark is the page itself.
    """
    text = F.trim(output, F.lit(" \n\t\r"))
    mark = r"(?m)^[ \t]*---CONTENT---[ \t]*$"
    parts = F.split(text, mark, 2)
    said = lambda name: F.transform(F.regexp_extract_all(parts[0], F.lit(rf"(?m)^{name}:(.*)$"), F.lit(1)), lambda x: F.trim(x))
    known = F.filter(F.transform(said("ACTION"), lambda x: F.lower(x)), lambda x: x.isin("complement", "duplicate", "conflict"))
    action = F.coalesce(F.try_element_at(known, F.lit(-1)), F.lit("complement"))
    content = F.coalesce(F.trim(F.try_element_at(parts, F.lit(2)), F.lit(" \n\t\r")), F.lit(""))
    whole = F.when((content == "") & (action == "complement"), strip_fence(output)).otherwise(content)
    return F.struct(action.alias("action"), whole.alias("content"), F.coalesce(F.try_element_at(said("CONFLICT_SUMMARY"), F.lit(-1)), F.lit("")).alias("conflict_summary"))


def conflicts(answers: DataFrame, date: str) -> DataFrame:
    """(name, text) of the answers (page, source, answer) that report a conflict; NONE is none."""
    found = answers.where(~F.upper(F.trim("answer")).startswith("NONE"))
    return found.select(F.concat(F.lit(f"{date}_"), F.substring("page", 1, 30), F.lit("_vs_"), F.substring("source", 1, 30)).alias("name"), F.trim("answer").alias("text"))
