"""Front matter, pages written anew and sheets, on what people write."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from docloom.functions import frontmatter
from docloom.operators import pages
from docloom.sources import office
from tests.fixture_pages import FRONT


def column(spark, f, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", f(F.col("t")).alias("v")).collect()
    return [r.v for r in sorted(rows, key=lambda r: r.k)]


def test_front_matter_equals_a_yaml_loader(spark):
    yaml = pytest.importorskip("yaml")
    kinds = {str: "string", bool: "bool", int: "int", float: "float", datetime.date: "date", list: "list", type(None): "null"}
    for text, got in zip(FRONT, column(spark, frontmatter.typed, *[f"---\n{t}\n---\nbody" for t in FRONT]), strict=True):
        want = yaml.safe_load(text) or {}
        assert set(got) == set(want), text
        for key, w in want.items():
            assert got[key].kind == kinds[type(w)], (text, key)
            if isinstance(w, list):
                assert got[key]["items"] == [x if x is None else str(x) for x in w]
            elif w is None or isinstance(w, str):
                assert got[key].text == w


def test_front_matter_by_hand(spark):
    got = column(spark, frontmatter.typed, "---\ntags: a\ntags: [x, \"y, z\"]\nt: 'it''s'\n---\n", "no front matter", None, "---\nnever closed: 1")
    assert {k: (v.kind, v.text, v["items"]) for k, v in got[0].items()} == {"tags": ("list", None, ["x", "y, z"]), "t": ("string", "it's", ["it's"])}
    assert got[1:] == [{}, {}, {}]


def test_quoted_reads_back(spark):
    texts = ["plain", "a: b", "- x", "", "null", "12", "2026-01-02", 'q"uote', "back\\slash", "two\nlines", "# no", "trail ", "[x]", "a #b", "é"]
    back = column(spark, lambda t: frontmatter.scalar(frontmatter.quoted(t)), *texts)
    assert back == texts


def test_sources_are_added_to_any_list(spark):
    add = lambda t: pages.with_source(t, F.lit("a.md"), "2026-01-02")
    for front in ("source_files: [a.md, b.md]", "source_files:\n- \"a.md\"\n- b.md", "source_files: c.md\nsource_files: [a.md, 'b.md']", "tags: x\ntags: y\nsource_files: ['a.md', b.md]"):
        (page,) = column(spark, add, f"---\n{front}\n---\n\nText")
        assert "source_files:\n- a.md\n- b.md\n" in page and page.count("a.md") == 1 and page.endswith("---\n\nText")
    assert column(spark, add, "---\nt: 1\n---\nx")[0] == "---\nlast_updated: 2026-01-02\nsource_files:\n- a.md\nt: 1\n---\n\nx"


def test_relations_of_unknown_types_are_related(spark):
    own = spark.createDataFrame([("a", "A", "---\nt: 1\n---\n\n# A"), ("b", "B", "# B")], "slug string, name string, content string")
    relations = spark.createDataFrame([("a", "b", "cousin"), ("b", "a", "parent"), ("a", "gone", "child")], "source string, target string, type string")
    got = {r.slug: r.content for r in pages.with_related(own, relations, "2026-01-02").collect()}
    assert "- [[b|B]] — 관련 개념" in got["a"] and "type: related" in got["a"] and "cousin" not in got["a"]
    assert "- [[a|A]] — 상위 개념" in got["b"]


def test_sheets_keep_odd_rows(spark):
    rows = [
        ("both", 0, 0, "h", None), ("both", 1, 0, "1.0", None), ("both", 2, 1, "a|b", "=X"), ("headless", 3, 0, "x", None), ("head", 0, 0, "only", None), ("head", 0, 1, None, None),
        ("twice", 0, 0, "h", None), ("twice", 1, 0, "a", None), ("twice", 1, 0, "b", None), (None, 0, 0, "n", None), ("lost", None, 0, "x", None), ("lost", 1, None, "x", None),
    ]
    df = spark.createDataFrame(rows, "sheet string, row int, col int, value string, formula string")
    got = {(r.sheet, r.block): r.markdown for r in office.sheet_pages(df, 2).collect()}
    assert got == {
        ("both", 1): "| h | 열2 |\n| --- | --- |\n| 1 |  |\n|  | a\\|b `[formula: =X]` |",
        ("headless", 2): "**행 3–3 / 전체 3행 (청크 2/2)**\n\n| 열1 |\n| --- |\n| x |",
        ("head", 1): "| only | 열2 |\n| --- | --- |",
        ("twice", 1): "| h |\n| --- |\n| b |",
        (None, 1): "| n |\n| --- |",
    }
    assert office.sheet_pages(df.limit(0), 2).count() == 0
