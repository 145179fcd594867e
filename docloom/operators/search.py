"""Full-text search: postings, BM25 with a prefix term, substring search and listings."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.distance import MOST, nearest, possible
from docloom.session import scratch

K1, B = 1.2, 0.75


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def postings(docs: DataFrame) -> DataFrame:
    """(term, doc_id, tf) of docs (doc_id, text)."""
    return docs.select("doc_id", F.explode(terms(F.col("text"))).alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("tf"))


def query_terms(query: str) -> list[str]:
    """The words of a query; all marks and operators are separators or words."""
    return re.findall(r"[^\W_]+", query.lower())


def bm25(docs: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """(doc_id, score): the documents that have all words, the last as a prefix, best first.

    Only the query's words are counted, in one pass over the texts; statistics
    are one row.
    """
    asked = query_terms(query)
    if not asked:
        return docs.sparkSession.createDataFrame([], "doc_id long, score double")
    words = docs.select("doc_id", terms(F.col("text")).alias("w"))
    match = lambda k, x: x.startswith(asked[k]) if k == len(asked) - 1 else x == asked[k]
    hits = lambda k: F.size(F.filter("w", lambda x: match(k, x))).cast("double")
    counted = words.select("doc_id", F.size("w").cast("double").alias("len"), *[hits(k).alias(f"f{k}") for k in range(len(asked))])
    stats = counted.agg(F.count("*").cast("double").alias("n"), F.avg("len").alias("avg"), *[F.sum((F.col(f"f{k}") > 0).cast("double")).alias(f"df{k}") for k in range(len(asked))])
    rows = counted.where(" AND ".join(f"f{k} > 0" for k in range(len(asked)))).crossJoin(F.broadcast(stats))  # stats is one row
    return rows.select("doc_id", F.round(score(len(asked)), 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(limit)


def score(n_terms: int) -> Column:
    """The score of rows with f0.., df0.., len, n and avg."""
    score = F.lit(0.0)
    for k in range(n_terms):
        idf = F.ln(1 + (F.col("n") - F.col(f"df{k}") + 0.5) / (F.col(f"df{k}") + 0.5))
        score = score + idf * F.col(f"f{k}") * (K1 + 1) / (F.col(f"f{k}") + K1 * (1 - B + B * F.col("len") / F.col("avg")))
    return score


def write_index(docs: DataFrame, folder: str | None = None) -> str:
    """Write an index of docs (doc_id, text) and return its folder: postings in order of term, lengths, and one row of statistics.

    Files and row groups hold ranges of terms, so a filter on terms reads only
    theirs; a frequent term's postings are cut by doc_id.
    """
    folder = folder or scratch(docs.sparkSession, "index")
    postings(docs).repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.parquet(f"{folder}/postings")
    docs.select("doc_id", F.size(terms(F.col("text"))).cast("long").alias("len")).write.parquet(f"{folder}/lengths")
    lengths = docs.sparkSession.read.schema("doc_id long, len long").parquet(f"{folder}/lengths")
    lengths.agg(F.count("*").cast("double").alias("n"), F.avg("len").alias("avg")).write.parquet(f"{folder}/stats")
    return folder


def bm25_stored(spark: SparkSession, folder: str, query: str, limit: int = 20) -> DataFrame:
    """As ``bm25``, from a written index: only the query's terms are read, and lengths of the documents that have all of them."""
    asked = query_terms(query)
    if not asked:
        return spark.createDataFrame([], "doc_id long, score double")
    stored = spark.read.schema("term string, doc_id long, tf long").parquet(f"{folder}/postings")
    both = spark.read.schema("n double, avg double").parquet(f"{folder}/stats")
    found = None
    for k, word in enumerate(asked):
        own = stored.where(F.col("term").startswith(word) if k == len(asked) - 1 else F.col("term") == word).groupBy("doc_id").agg(F.sum("tf").cast("double").alias(f"f{k}"))
        both = both.crossJoin(own.agg(F.count("*").cast("double").alias(f"df{k}")))  # one row each
        found = own if found is None else found.join(own, "doc_id")
    rows = found.join(spark.read.schema("doc_id long, len long").parquet(f"{folder}/lengths"), "doc_id").crossJoin(F.broadcast(both))  # both is one row
    return rows.select("doc_id", F.round(score(len(asked)), 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(limit)


def substring(docs: DataFrame, query: str, limit: int = 20, around: int = 60) -> DataFrame:
    """(doc_id, snippet) of the first documents that hold the query in any case, with characters around its first place."""
    low = F.lower("text")
    at = F.instr(low, query.lower())
    start = F.greatest(at - around, F.lit(1))
    rows = docs.where(low.contains(query.lower())).select("doc_id", F.substring(F.col("text"), start, at - start + len(query) + around).alias("snippet"))
    return rows.orderBy("doc_id").limit(limit)


def fuzzy(rows: DataFrame, query: str, limit: int = 20, threshold: float = 0.4) -> DataFrame:
    """(slug, score): rows (slug, title, summary) of which a part of either is near the query, best first; title weighs 2, summary 1.

    A field's score is the query's least edit distance to any part of it, over the query's length; at least 0.001,
    or next to nothing if the field is the query. Fields above the threshold don't count. A row's score is the product of its fields' scores, each
    to the power of its weight by the root of its number of words. Only fields that have enough of the query's q-grams are compared.
    A query of over 61 characters is compared in pieces, whose distances are added.
    """
    asked = query.lower()
    most = int(threshold * len(asked))
    if not asked:
        return rows.select("slug", F.lit(0.0).alias("score")).limit(0)
    parts = [asked[k : k + MOST] for k in range(0, len(asked), MOST)]

    def field(name: str, weight: float) -> Column:
        own = F.lower(F.coalesce(name, F.lit("")))
        may = [possible(own, x, most) for x in parts]
        near = [nearest(own, x) for x in parts]
        gap = F.when(reduce(Column.__and__, may), reduce(Column.__add__, near)) / len(asked)
        norm = F.round(1 / F.sqrt(F.greatest(F.lit(1), F.size(F.regexp_extract_all(own, F.lit("[^ ]+"), F.lit(0))))), 3)
        value = F.when(own == asked, 2.0**-52).otherwise(F.greatest(gap, F.lit(0.001)))
        return F.when(gap <= threshold, F.pow(value, weight * norm))

    scores = rows.select("slug", field("title", 2 / 3).alias("t"), field("summary", 1 / 3).alias("s")).where("t IS NOT NULL OR s IS NOT NULL")
    return scores.select("slug", F.round(F.coalesce("t", F.lit(1.0)) * F.coalesce("s", F.lit(1.0)), 6).alias("score")).orderBy("score", "slug").limit(limit)


def sync(indexed: DataFrame, files: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """(path, action): what an index of (path, mtime) needs to follow files (path, mtime)."""
    both = indexed.withColumnRenamed("mtime", "was").join(files, "path", "full")
    action = F.when(F.col("mtime").isNull(), "delete").when(F.col("was").isNull(), "insert").when(F.abs(F.col("mtime") - F.col("was")) < tolerance, "skip").otherwise("update")
    return both.select("path", action.alias("action"))


def listing(concepts: DataFrame, q: str | None = None, status: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """(slug, title, status, total): a page of concepts by slug, with the number of all that match."""
    rows = concepts
    if q:
        rows = rows.where(F.lower("slug").contains(q.lower()) | F.lower("title").contains(q.lower()))
    if status:
        rows = rows.where(F.col("status") == status)
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy("slug").offset(offset).limit(limit).crossJoin(F.broadcast(total)).select("slug", "title", "status", "total")  # total is one row
