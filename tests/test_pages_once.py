"""Pages written anew read their text a few times, whatever their front matter holds."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import pages

ODD = [None, "", "---\nopen", "---\n---", "---\nt: 1\n---\n\x0b\f \n# A\n\t", "x\n---\nt: 1\n---\ny", "---t: 1\n----\nz 😀\n"]


def mentions(frame, name: str) -> int:
    """How often a plan names a column; for the text of a page, each is at least one reading."""
    return frame._jdf.queryExecution().analyzed().toString().count(f"{name}#")


def column(spark, f, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, content string").select("k", f(F.col("content")).alias("v")).collect()
    return [r.v for r in sorted(rows, key=lambda r: r.k)]


def test_a_source_is_added_in_a_few_readings(spark):
    add = lambda t: pages.with_source(t, F.lit("a.md"), "2026-01-02")
    assert mentions(spark.createDataFrame([("x",)], "content string").select(add(F.col("content"))), "content") < 20
    head = "---\nlast_updated: 2026-01-02\nsource_files:\n- a.md\n"
    assert column(spark, add, ODD) == [None, f"{head}---\n\n", f"{head}---\n\n---\nopen", f"{head}---\n\n", f"{head}t: 1\n---\n\n# A", f"{head}---\n\nx\n---\nt: 1\n---\ny", f"{head}t: 1\n---\n\n-\nz 😀"]


def test_related_sections_are_written_in_a_few_readings(spark):
    own = spark.createDataFrame([("a", "A", "x"), ("b", "B", "y")], "slug string, name string, content string")
    relations = spark.createDataFrame([("a", "b", "child")], "source string, target string, type string")
    assert mentions(pages.with_related(own, relations, "2026-01-02"), "content") < 40


def test_a_section_is_replaced_up_to_the_next(spark):
    new = lambda t: pages.with_section(t, "H", F.lit("## H\n\nnew"))
    texts = [None, "", "a\n", "## H\nold", "a\n##H  \nold\n## H\nagain", "a\n## H\n\n## N\nb\n", "a ## H\n", "### H\n", "😀\n## H\n$1\n### N\\", "## H"]
    end = "\n\n## H\n\nnew\n"
    assert column(spark, new, texts) == [None, end, f"a{end}", "## H\n\nnew\n\n", "a\n## H\n\nnew\n\n\n## H\nagain", "a\n## H\n\nnew\n\n\n## N\nb\n", f"a ## H{end}", f"### H{end}", "😀\n## H\n\nnew\n\n\n### N\\", f"## H{end}"]
