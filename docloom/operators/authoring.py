"""Concept pages that come out of extracted concepts: created, complemented, left with one more source, or marked as in conflict.

The model is a function that is passed in. Several concepts of one page are worked on one after the other, in
order of source and name, since each sees the page as the one before left it: a round takes
the next concept of every page, so there are as many rounds as one page has concepts at most. Only touched
pages are written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import file_stem, first_h1, render, strip_fence
from docloom.operators.compiling import Completion, mapped
from docloom.operators.outputs import merge_answer
from docloom.operators.pages import with_notice, with_source
from docloom.session import materialize

#: What the model is asked for a page that isn't there, and for one that is.
NEW_PAGE = "개념: {{ name }}\n요약: {{ summary }}\n유사 개념: {{ similar }}\n출처: {{ source }}\n\n{{ text }}"
MERGE_PAGE = "개념: {{ name }}\n요약: {{ summary }}\n출처: {{ source }}\n\n{{ text }}\n\n기존 문서:\n{{ page }}"


def targets(concepts: DataFrame, pages: DataFrame) -> DataFrame:
    """Concepts (source, name, summary, existing_match, match_type, text) with the page (slug) that they are for.

    An exact match that a page has by slug, else by name, is for that page; everything else is for the page of its own name.
    """
    exact = F.when(F.col("match_type") == "exact", F.col("existing_match"))
    rows = concepts.withColumns({"_own": file_stem(F.col("name")), "_match": exact, "_stem": file_stem(exact)})
    slugs = pages.select(F.col("slug").alias("_stem"), F.col("slug").alias("_by_slug"))
    names = pages.groupBy(F.col("name").alias("_match")).agg(F.min("slug").alias("_by_name"))
    found = rows.join(slugs, "_stem", "left").join(names, "_match", "left")
    return found.withColumn("slug", F.coalesce("_by_slug", "_by_name", "_own")).drop("_own", "_match", "_stem", "_by_slug", "_by_name")


def _answered(answers: DataFrame, date: str) -> DataFrame:
    """Answers (slug, source, name, old, answer) with what becomes of the page: action, content, conflict_summary, report.

    Steps are columns of their own, since each stands in the next several times.
    """
    said, old = F.col("said"), F.col("old")
    rows = answers.withColumns({"report": F.concat(F.lit("conflicts/"), F.lit(date), F.lit("_"), "slug", F.lit(".md")), "answer": F.coalesce("answer", F.lit(""))})
    rows = rows.withColumns({"said": merge_answer(F.col("answer")), "fresh": strip_fence(F.col("answer"))})
    rows = materialize(rows, "answers")
    rows = rows.withColumn("base", F.when(said["action"] == "conflict", with_notice(old, F.col("source"), F.col("report"))).otherwise(old))
    rows = materialize(rows, "bases").withColumn("sourced", with_source(F.col("base"), F.col("source"), date))
    merged = F.when((said["action"] == "complement") & (said["content"] != ""), said["content"]).otherwise(F.col("sourced"))
    action = F.when(said["action"] == "complement", "complemented").otherwise(said["action"])
    content = F.when(old.isNull(), F.col("fresh")).otherwise(merged)
    rows = rows.select("slug", "source", "name", "report", said["conflict_summary"].alias("conflict_summary"), F.when(old.isNull(), "created").otherwise(action).alias("action"), content.alias("content"))
    return rows.withColumn("action", F.when(F.col("content") == "", "").otherwise(F.col("action")))


def compiled(concepts: DataFrame, pages: DataFrame, completion: Completion, date: str) -> tuple[DataFrame, DataFrame]:
    """Compile concepts into pages (slug, name, content).

    Returns the touched pages (slug, name, content), named by their top heading, and the log (round, slug, source, name, action, report, conflict_summary).
    A blank answer for a page that isn't there makes no page; its action is empty. Names without letters or digits are left out.
    """
    order = F.row_number().over(Window.partitionBy("slug").orderBy("source", "name", "text"))
    rows = materialize(targets(concepts, pages).where("slug <> ''").withColumn("round", order), "concepts")
    touched, log, k = pages.select("slug", "name", "content").limit(0), None, 1
    while True:
        now = rows.where(F.col("round") == k)
        if k > 1 and not now.limit(1).count():
            return touched, log
        known = touched.unionByName(pages.select("slug", "name", "content").join(touched.select("slug"), "slug", "left_anti"))
        asked = now.join(known.select("slug", F.col("content").alias("old")), "slug", "left")
        values = {c: F.coalesce(c, F.lit("")) for c in ("name", "summary", "source", "text")} | {"similar": F.coalesce("existing_match", F.lit("없음")), "page": F.coalesce("old", F.lit(""))}
        prompt = F.when(F.col("old").isNull(), render(NEW_PAGE, values)).otherwise(render(MERGE_PAGE, values))
        answers = mapped(asked.withColumn("prompt", prompt), F.col("prompt"), completion, ["slug", "source", "name", "old"])
        done = materialize(_answered(answers, date), f"round-{k}")
        new = done.where("content <> ''").select("slug", F.coalesce(first_h1(F.col("content")), F.col("name")).alias("name"), "content")
        touched = materialize(touched.join(new.select("slug"), "slug", "left_anti").unionByName(new), f"pages-{k}")
        own = done.select(F.lit(k).alias("round"), "slug", "source", "name", "action", F.when(F.col("action") == "conflict", F.col("report")).alias("report"), F.when(F.col("action") == "conflict", F.col("conflict_summary")).alias("conflict_summary"))
        log = own if log is None else log.unionByName(own)
        k += 1
