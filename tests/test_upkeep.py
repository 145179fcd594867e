"""Batches that stop, steps that are repeated, file budgets, known members and the order of titles."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docloom.operators import batches, index, org, outputs
from docloom.session import scratch
from docloom.sources import ingest
from docloom.streaming import steps


def test_a_batch_goes_on_where_it_stopped(spark):
    files = spark.createDataFrame([(f"f{k}", f"text {k}") for k in range(40)] + [("f1", "another"), (None, "no path"), ("f50", None)], "path string, content string")
    calls = spark.sparkContext.accumulator(0)
    folder = scratch(spark, "ledger")

    def work(path, content, attempt):
        calls.add(1)
        if path == "f3":
            raise ValueError("broken")
        if path in ("f4", "f5") and attempt < 3 or path == "f6":
            raise RuntimeError("Rate limit")
        return f"{content}!"

    # it stops after two of four slices
    own = files.where("path IS NOT NULL").groupBy("path").agg(F.max("content").alias("content"))
    part = own.where(F.pmod(F.xxhash64("path"), F.lit(4)) < 2)
    batches.run(part, work, folder, slices=4, attempts=1)
    empty = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/attempt=1/slice=3")
    empty.getFileSystem(spark._jsc.hadoopConfiguration()).delete(empty, True)  # these had no rows
    empty = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/attempt=1/slice=2")
    empty.getFileSystem(spark._jsc.hadoopConfiguration()).delete(empty, True)
    before = calls.value
    assert 0 < before == part.count()
    pauses = []
    got = {r.path: (r.result, r.error, r.attempt) for r in batches.run(files, work, folder, slices=4, attempts=4, pause=pauses.append).collect()}
    assert calls.value == 41 + 3 + 3 + 1 and pauses == [2, 3, 4]  # each once, then those that the limit met
    assert got["f3"] == (None, "ValueError: broken", 1) and got["f4"] == ("text 4!", None, 3) and got["f6"] == (None, "RuntimeError: Rate limit", 4)
    assert got["f1"] == ("text 1!", None, 1) and got["f50"] == ("!", None, 1) and len(got) == 41
    again = calls.value
    assert batches.run(files, work, folder, slices=4, attempts=4).count() == 41 and calls.value == again
    r = batches.report(batches.ledger(spark, folder)).first()
    assert (r["files"], r["succeeded"], r["failed"], r["retried"]) == (41, 39, 2, 3)


def test_a_repeated_batch_changes_nothing(spark):
    own = steps.Steps(spark, scratch(spark, "steps"))
    page = lambda k, text: (k, f"Doc_{k}", text)
    frame = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, slug string, content string")
    state = lambda: (sorted(map(tuple, own.edges().collect())), sorted(map(tuple, own.log().collect())), sorted(map(tuple, own.index().postings().collect())), own.index().version())
    first, second = frame(page(1, "see [[Doc 2]]"), page(2, "plain")), frame(page(1, "now [[Doc 3]] and [[Doc 2]]"), page(3, "new"), page(3, "new"))
    steps.after(own, first, 0)
    steps.after(own, second, 1)
    done = state()
    assert done[0] == [("Doc_1", 0, "Doc_3"), ("Doc_1", 1, "Doc_2")] and done[1] == [(0, 2, 1), (1, 2, 2)] and done[3] == 2
    steps.after(own, second, 1)
    assert state() == done

    # a batch that failed between its steps, then came again
    broken = frame(page(2, "later [[Doc 1]]"))
    update, index.update = index.update, None
    try:
        with pytest.raises(TypeError):
            steps.after(own, broken, 2)
    finally:
        index.update = update
    steps.after(own, broken, 2)
    edges, log, postings, version = state()
    assert edges == [*done[0], ("Doc_2", 0, "Doc_1")] and log == [*done[1], (2, 1, 1)] and version == 3
    fresh = index.update(index.open_index(spark), spark.createDataFrame([(1, "now [[Doc 3]] and [[Doc 2]]"), (2, "later [[Doc 1]]"), (3, "new")], "doc_id long, text string"))
    assert postings == sorted(map(tuple, fresh.postings().collect()))


def test_a_repository_takes_its_first_file_always(spark):
    rows = [("a", "README.md", 10, 70_000), ("a", "x.py", 5, 10), ("b", "src/a.py", 10, 50_000), ("b", "src/b.py", 20, 20_000), ("b", "src/c.py", 30, 10_000), ("b", "big.py", 200_000, 1), ("b", "dist/x.py", 1, 1)]
    got = {(r.repo, r.path): r.taken for r in ingest.chosen_files(spark.createDataFrame(rows, "repo string, path string, size long, tokens long")).collect()}
    assert got == {("a", "README.md"): True, ("a", "x.py"): False, ("b", "src/a.py"): True, ("b", "src/b.py"): False, ("b", "src/c.py"): True}


def test_groups_of_known_members(spark):
    answers = [(1, '[{"canonical": "A", "members": ["a", "b", "ghost"]}, {"canonical": "B", "members": ["b", "ghost"]}]'), (2, "no json"), (3, None)]
    got = outputs.parse_groups(spark.createDataFrame(answers, "source long, output string"), spark.createDataFrame([("a",), ("b",), ("b",)], "name string")).collect()
    assert [(r.source, r.canonical, r.members) for r in got] == [(1, "A", ["a", "b"])]


def test_titles_in_korean_order(spark):
    want = ["1장", "2", "가나다", "가방", "나무", "하늘", "apple", "Apple", "banana", "zebra"]
    df = spark.createDataFrame([(t,) for t in reversed(want)], "title string").repartition(3)
    assert [r.title for r in org.placed_by_title(df).orderBy("pos").collect()] == want
    assert [r.title for r in org.top_by_title(df.withColumn("slug", F.col("title")), 3).collect()] == want[:3]
