"""Stored indexes against fresh ones and brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from docloom.functions import distance
from docloom.operators import grams, index, search

WORDS = ["the", "and", "eau", "page", "licence", "x1", "café", "한국어"]


def text(rng):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "."]) for _ in range(rng.randint(0, 12)))


def rows(own):
    return sorted(tuple(r) for r in own.postings().collect()), sorted(tuple(r) for r in own.lengths().collect()), own.stats()


def test_an_index_kept_up_is_a_fresh_one(spark):
    rng, now, own = random.Random(1), {}, index.open_index(spark)
    for step in range(6):
        changed = {rng.randint(0, 60): text(rng) for _ in range(12 if step else 40)}
        gone = set(rng.sample(sorted(now), min(len(now), 5))) - set(changed)
        now = {k: v for k, v in now.items() if k not in gone} | changed
        index.update(own, spark.createDataFrame(list(changed.items()), "doc_id long, text string"), spark.createDataFrame([(k,) for k in [*gone, 999]], "doc_id long"), fan=2)
        assert own.version() == step + 1
        fresh = index.update(index.open_index(spark), spark.createDataFrame(list(now.items()), "doc_id long, text string"))
        assert rows(own) == rows(fresh)
        assert own.manifest().count() <= 6
        for asked in ("the ea", "licences", "and"):
            want = search.bm25(spark.createDataFrame(list(now.items()), "doc_id long, text string"), asked).collect()
            assert index.bm25(own, asked).collect() == want
    index.update(own, spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(k,) for k in now], "doc_id long"))
    assert rows(own) == ([], [], (0, 0.0)) and index.bm25(own, "the").collect() == []
    index.update(own, spark.createDataFrame([(3, "again the"), (3, "again the"), (None, "no id"), (4, None)], "doc_id long, text string"))
    assert rows(own)[0] == [("again", 3, 1), ("the", 3, 1)] and rows(own)[1] == [(3, 2), (4, 0)]


def test_an_update_that_broke_off_leaves_nothing(spark):
    own = index.update(index.open_index(spark), spark.createDataFrame([(1, "old text"), (2, "stays")], "doc_id long, text string"))
    was = rows(own)
    # what an update that was lost before its manifest leaves behind
    index._write_segment(own, 2 << 8, search.postings(spark.createDataFrame([(1, "half done")], "doc_id long, text string")), spark.createDataFrame([(1, 2)], "doc_id long, len long"))
    spark.createDataFrame([(1 << 8, 1)], "segment int, doc_id long").write.parquet(f"{own.folder}/dead/update=2")
    assert rows(own) == was
    index.update(own, spark.createDataFrame([(1, "new text")], "doc_id long, text string"))
    assert {t for t, *_ in rows(own)[0]} == {"new", "text", "stays"}


def test_an_update_reads_only_what_changed(spark):
    own = index.update(index.open_index(spark), spark.createDataFrame([(k, f"word{k} the") for k in range(50)], "doc_id long, text string"))
    first = own.manifest().collect()[0].segment
    index.update(own, spark.createDataFrame([(1, "changed")], "doc_id long, text string"), fan=10)
    assert {r.segment for r in own.manifest().collect()} == {first, 2 << 8}  # nothing was rewritten
    plan = own.postings().where("term = 'changed'")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,changed)" in plan


@pytest.mark.parametrize("query", ["the", "licence", "ca", "x", "한국", "é", "page. the", "zzz", "and"])
def test_grams_find_what_a_scan_finds(spark, query):
    rng = random.Random(2)
    docs = spark.createDataFrame([(k, text(rng).upper() if k % 3 else text(rng), f"s{k}_{rng.choice(WORDS)}") for k in range(80)] + [(100, None, None), (101, "", "the_page")], "doc_id long, text string, stem string")
    own = grams.write_grams(docs)
    assert grams.substring(own, query, 7).collect() == search.substring(docs, query, 7).collect()
    assert {r.doc_id for r in docs.where(F.lower("text").contains(query)).collect()} <= {r.doc_id for r in grams.candidates(own, query).collect()}


def test_grams_rank_as_a_scan_does(spark, monkeypatch):
    from docloom.operators.context import scored

    monkeypatch.setattr(grams, "BATCH", 4)
    rng = random.Random(3)
    docs = spark.createDataFrame([(k, text(rng), f"s{k % 5}_{rng.choice(WORDS)}") for k in range(90)], "doc_id long, text string, stem string")
    own = grams.write_grams(docs)
    for question in ("licence and café of page", "x1 x1 an", "한국어 eaus", "nothing here", "?"):
        want = scored(docs, question, F.col("text"), F.col("stem")).where("score > 0").orderBy(F.desc("score"), "doc_id").limit(5).select("doc_id", F.round("score", 9)).collect()
        assert [(r.doc_id, round(r.score, 9)) for r in grams.relevant(own, question, 5).collect()] == [tuple(r) for r in want]


def least(pattern, words):
    row = [0] * (len(words) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(words, 1):
            new.append(min(row[j - 1] + (p != c), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


@pytest.mark.parametrize("size", [1, 2, 7, 15, 33, 61])
def test_bit_vectors_equal_a_table(spark, size):
    rng = random.Random(size)
    pattern = "".join(rng.choice("abcdé") for _ in range(size))
    texts = ["", None, pattern, "x" + pattern + "y", "a" * 300]
    for _ in range(120):
        near = list(pattern)
        for _ in range(rng.randint(0, size)):
            k = rng.randrange(len(near) + 1)
            near[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "z", "bc"])
        texts.append("".join(rng.choice("abcdez") for _ in range(rng.randint(0, 20))) + "".join(near) + "tail")
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for most in (0, size // 4, size // 2, size):
        for r in df.select("t", distance.nearest(F.col("t"), pattern).alias("d"), distance.possible(F.col("t"), pattern, most).alias("may")).collect():
            assert r.d == (None if r.t is None else least(pattern, r.t)), r.t
            assert r.t is None or r.may or r.d > most
