"""Substring search and relevance by stored trigrams: postings are intersected, and only candidates' texts are read.

A folder holds ``grams`` (gram, doc_id, in order of gram), ``texts`` (doc_id, text, in order of
doc_id) and ``names`` (doc_id, stem). Two marks end each text, so every character begins a gram: words of
up to three characters are answered by postings alone, longer ones have candidates, which are compared.
Everything is in lower case. Null texts and stems are empty; doc_id is unique.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import question_words
from docloom.session import materialize, scratch

END = "\u0000\u0000"
#: So many candidates' texts are read at once.
BATCH = 512


@dataclass(frozen=True)
class Grams:
    """Where the index is."""

    spark: SparkSession
    folder: str

    def table(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")


def grams_of(text: Column) -> Column:
    """The distinct trigrams of a text with its end marks."""
    return F.array_distinct(F.regexp_extract_all(F.concat(F.lower(F.coalesce(text, F.lit(""))), F.lit(END)), F.lit(r"(?s)(?=(...))"), F.lit(1)))


def write_grams(docs: DataFrame, folder: str | None = None) -> Grams:
    """Write the index of docs (doc_id, text, stem)."""
    folder = folder or scratch(docs.sparkSession, "grams")
    docs.select(F.explode(grams_of(F.col("text"))).alias("gram"), F.col("doc_id").cast("long").alias("doc_id")).repartitionByRange("gram", "doc_id").sortWithinPartitions("gram", "doc_id").write.parquet(f"{folder}/grams")
    docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.option("parquet.block.size", 1 << 23).parquet(f"{folder}/texts")
    docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.coalesce("stem", F.lit(""))).alias("stem")).write.parquet(f"{folder}/names")
    return Grams(docs.sparkSession, folder)


def candidates(index: Grams, word: str) -> DataFrame:
    """(doc_id) of the documents that have all trigrams of a non-empty word in lower case; up to three characters, those that have the word."""
    stored = index.table("grams", "gram string, doc_id long")
    if len(word) <= 3:
        return stored.where(F.col("gram").startswith(word) if len(word) < 3 else F.col("gram") == word).select("doc_id").distinct()
    own = sorted({word[k : k + 3] for k in range(len(word) - 2)})
    return stored.where(F.col("gram").isin(own)).groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") == len(own)).select("doc_id")


def _texts(index: Grams, ids: list[int]) -> DataFrame:
    """Candidates' texts; the filter reaches the files, which are in order of doc_id."""
    return index.table("texts", "doc_id long, text string").where(F.col("doc_id").isin(ids) & F.col("doc_id").between(min(ids), max(ids)))


def substring(index: Grams, query: str, limit: int = 20, around: int = 60) -> DataFrame:
    """(doc_id, snippet) of the first documents that hold the query in any case, with characters around its first place."""
    asked, found, last = query.lower(), [], None
    possible = materialize(candidates(index, asked), "candidates") if asked else index.table("names", "doc_id long, stem string").select("doc_id")
    low = F.lower("text")
    at = F.instr(low, asked) if asked else F.lit(1)
    start = F.greatest(at - around, F.lit(1))
    snippet = F.substring(F.col("text"), start, at - start + len(query) + around)
    size = 2 * limit
    while len(found) < limit:
        rows = possible if last is None else possible.where(F.col("doc_id") > last)
        ids = [r.doc_id for r in rows.orderBy("doc_id").limit(size).collect()]
        if not ids:
            break
        found += [tuple(r) for r in _texts(index, ids).where(low.contains(asked)).select("doc_id", snippet).orderBy("doc_id").collect()]
        last, size = ids[-1], min(2 * size, BATCH)
    return index.spark.createDataFrame(found[:limit], "doc_id long, snippet string")


def relevant(index: Grams, question: str, limit: int = 25) -> DataFrame:
    """(doc_id, score): the best documents for a question, by its words in texts (1 each) and stems (2), over the number of words.

    Candidates have an upper bound of their score from postings and stems. They are
    compared from the highest bound down, until the bound of the next is not better than the last of the best.
    """
    words = question_words(question)
    if not words:
        return index.spark.createDataFrame([], "doc_id long, score double")
    times = {w: words.count(w) for w in words}
    names = index.table("names", "doc_id long, stem string").select("doc_id", F.replace("stem", F.lit("_"), F.lit(" ")).alias("stem"))
    hits = [F.when(F.col("stem").contains(w), 2 * n).otherwise(0) for w, n in times.items()]
    rows = names.select("doc_id", sum(hits[1:], hits[0]).cast("long").alias("sure"), F.lit(0).cast("long").alias("open")).where("sure > 0")
    for w, n in times.items():
        rows = rows.union(candidates(index, w).select("doc_id", F.lit(n if len(w) <= 3 else 0).cast("long"), F.lit(0 if len(w) <= 3 else n).cast("long")))
    bounds = materialize(rows.groupBy("doc_id").agg(F.sum("sure").alias("sure"), F.sum("open").alias("open")).withColumn("bound", F.col("sure") + F.col("open")), "bounds")
    long = {w: n for w, n in times.items() if len(w) > 3}
    best: list[tuple[int, int]] = []  # (-score, doc_id)
    last, size = None, 2 * limit
    while True:
        after = bounds if last is None else bounds.where((F.col("bound") < last[0]) | ((F.col("bound") == last[0]) & (F.col("doc_id") > last[1])))
        near = after.orderBy(F.desc("bound"), "doc_id").limit(size).collect()
        if not near or (len(best) >= limit and best[limit - 1] < (-near[0].bound, near[0].doc_id)):
            break
        unsure = [r.doc_id for r in near if r.open]
        told = {}
        if unsure:
            low = F.lower("text")
            each = [F.when(low.contains(w), n).otherwise(0) for w, n in long.items()]
            told = {r[0]: r[1] for r in _texts(index, unsure).select("doc_id", sum(each[1:], each[0])).collect()}
        best = sorted(best + [(-(r.sure + told.get(r.doc_id, 0)), r.doc_id) for r in near if r.sure + told.get(r.doc_id, 0) > 0])[:limit]
        last, size = (near[-1].bound, near[-1].doc_id), BATCH
    return index.spark.createDataFrame([(d, -s / len(words)) for s, d in best], "doc_id long, score double")
