"""Map and reduce over chunks, and merging of extracted concepts. The model is a function that is passed in."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import byte_head, estimate_tokens, json_array
from docloom.operators.packing import next_fit
from docloom.session import materialize

Completion = Callable[[list[str]], list[str]]


def first_words(prompts: list[str]) -> list[str]:
    """A stand-in for a model: the first 40 characters of the last line."""
    return [p.strip().rsplit("\n", 1)[-1][:40] for p in prompts]


def mapped(rows: DataFrame, prompt: Column, completion: Completion, keys: list[str]) -> DataFrame:
    """(keys..., answer): the model's answer to each row's prompt, in Arrow batches."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keys)

    def run(batches):
        for pdf in batches:
            yield pdf[keys].assign(answer=pd.Series(completion(pdf["_prompt"].tolist()), dtype="object", index=pdf.index))

    return rows.select(*keys, prompt.alias("_prompt")).mapInPandas(run, f"{schema}, answer string")


def reduced(answers: DataFrame, by: list[str], order: str) -> DataFrame:
    """(by..., prompt): the answers of a group in order, each under its number."""
    block = F.format_string("### 청크 %d\n%s", F.col(order), F.col("answer"))
    blocks = F.array_sort(F.collect_list(F.struct(order, block.alias("b"))))
    return answers.groupBy(*by).agg(F.array_join(F.transform(blocks, lambda x: x["b"]), "\n\n---\n\n").alias("prompt"))


def summarise(chunks: DataFrame, completion: Completion) -> DataFrame:
    """(doc_id, summary) of chunks (doc_id, strategy, index, group, content): by chunk, by group for hierarchical ones, by document."""
    answers = mapped(chunks, F.col("content"), completion, ["doc_id", "strategy", "index", "group"])
    flat = answers.where("strategy <> 'hierarchical'").select("doc_id", F.col("index").alias("n"), "answer")
    groups = reduced(answers.where("strategy = 'hierarchical'"), ["doc_id", "group"], "index")
    tree = mapped(groups, F.col("prompt"), completion, ["doc_id", "group"]).select("doc_id", (F.col("group") + 1).alias("n"), "answer")
    return mapped(reduced(flat.unionByName(tree), ["doc_id"], "n"), F.col("prompt"), completion, ["doc_id"]).withColumnRenamed("answer", "summary")


#: What stands between two answers of a prompt, in tokens, and a heading's share.
GLUE = 8


def summarised_within(chunks: DataFrame, completion: Completion, budget: int) -> DataFrame:
    """(doc_id, summary, rounds) of chunks (doc_id, index, content): answers are packed in order into prompts of at most ``budget`` tokens, and their answers again, until a document has one.

    An answer that is too long for the budget by itself is cut to half of it, so that two always fit and each round at least halves a document's answers.
    """
    half = max(1, (budget - 2 * GLUE) // 2)
    fitted = lambda c: F.when(estimate_tokens(c) <= half, c).otherwise(byte_head(c, 4 * half))
    rows = mapped(chunks, byte_head(F.col("content"), 4 * budget), completion, ["doc_id", "index"]).select("doc_id", F.col("index").cast("long").alias("at"), fitted(F.col("answer")).alias("answer"))
    done, k = None, 0
    while True:
        n = F.row_number().over(Window.partitionBy("doc_id").orderBy("at")) - 1
        rows = materialize(rows.select("doc_id", n.cast("long").alias("n"), "answer"), f"round-{k}")
        several = rows.groupBy("doc_id").agg(F.max("n").alias("last"))
        single = rows.join(several.where("last = 0"), "doc_id", "left_semi").select("doc_id", F.col("answer").alias("summary"), F.lit(k).alias("rounds"))
        done = single if done is None else done.unionByName(single)
        rest = rows.join(several.where("last > 0"), "doc_id", "left_semi")
        if not rest.limit(1).count():
            return done
        bins = next_fit(rest.select(F.col("doc_id").alias("key"), "n", (estimate_tokens(F.col("answer")) + GLUE).alias("tokens"), F.lit(False).alias("alone")), budget)
        grouped = rest.join(bins.withColumnRenamed("key", "doc_id"), ["doc_id", "n"]).withColumn("number", F.col("n") + 1)
        prompts = reduced(grouped, ["doc_id", "bin"], "number")  # as large as the budget
        rows = mapped(prompts, F.col("prompt"), completion, ["doc_id", "bin"]).select("doc_id", F.col("bin").alias("at"), fitted(F.col("answer")).alias("answer"))
        k += 1


CONCEPT = "array<struct<name:string,summary:string,existing_match:string,match_type:string>>"


def parse_concepts(outputs: DataFrame) -> DataFrame:
    """(source, idx, pos, name, summary, existing_match, match_type) of model outputs (source, idx, output); broken ones give nothing."""
    rows = outputs.select("source", "idx", F.posexplode(F.from_json(json_array(F.col("output")), CONCEPT)).alias("pos", "c")).select("source", "idx", "pos", "c.*")
    return rows.where(F.trim("name") != "")


def merge_concepts(found: DataFrame, most: int = 20) -> DataFrame:
    """(source, name, chunks, summary, existing_match, match_type): one row for each name of a source.

    The longest summary counts, of equals the earliest; the first match counts;
    the first ``most`` names by chunk and place are kept.
    """
    at = F.struct("idx", "pos")
    merged = found.groupBy("source", "name").agg(
        F.array_join(F.transform(F.array_sort(F.collect_set("idx")), lambda x: x.cast("string")), ",").alias("chunks"),
        F.min(F.struct((-F.length("summary")).alias("order"), "idx", "pos", "summary")).alias("s"),
        F.min(F.when(F.col("existing_match").isNotNull(), F.struct("idx", "pos", "existing_match", "match_type"))).alias("m"), F.min(at).alias("at"),
    )
    ranked = merged.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy("at"))).where(F.col("rank") <= most)
    return ranked.select("source", "name", "chunks", F.col("s.summary").alias("summary"), "m.existing_match", "m.match_type")


def actions(found: DataFrame, existing: DataFrame) -> DataFrame:
    """(source, created, complemented, similar): what compiling concepts does to the existing pages (name)."""
    rows = found.join(existing.select("name", F.lit(True).alias("there")).distinct(), "name", "left")
    there, similar = F.coalesce("there", F.lit(False)), F.coalesce(F.col("match_type") == "similar", F.lit(False))
    return rows.groupBy("source").agg(F.count_if(~there & ~similar).alias("created"), F.count_if(there).alias("complemented"), F.count_if(~there & similar).alias("similar"))


def keyword_chunks(chunks: DataFrame, keywords: list[str], budget: int) -> DataFrame:
    """(doc_id, index, hits, tokens): of each document the chunks with most keywords, until the first that doesn't fit."""
    low = F.lower("content")
    hits = F.lit(0)
    for k in sorted(set(keywords)):
        hits = hits + low.contains(k).cast("int")
    rows = chunks.select("doc_id", "index", hits.alias("hits"), F.col("token_count").alias("tokens")).where("hits > 0")
    used = F.sum("tokens").over(Window.partitionBy("doc_id").orderBy(F.desc("hits"), "index").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("used", used).where(F.col("used") <= budget).drop("used")


def tagged_chunks(chunks: DataFrame, budget: int) -> DataFrame:
    """(doc_id, index): of chunks (doc_id, index, tokens, tagged) the tagged ones, then their neighbours, each if it still fits.

    One that doesn't fit is skipped and the next is tried, so a document's
    choices are folded in order.
    """
    near = chunks.where("tagged").select("doc_id", F.explode(F.sequence(F.col("index") - 1, F.col("index") + 1)).alias("index")).distinct()
    rows = chunks.join(near, ["doc_id", "index"], "left_semi").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct((~F.col("tagged")).alias("later"), "index", "tokens"))).alias("c"))
    kind = "struct<taken:array<bigint>,left:bigint>"
    zero = F.struct(F.array().cast("array<bigint>").alias("taken"), F.lit(budget).cast("long").alias("left")).cast(kind)

    def step(acc: Column, x: Column) -> Column:
        fits = x["tokens"] <= acc["left"]
        return F.struct(F.when(fits, F.array_append(acc["taken"], x["index"].cast("long"))).otherwise(acc["taken"]).alias("taken"), F.when(fits, acc["left"] - x["tokens"]).otherwise(acc["left"]).alias("left")).cast(kind)

    return rows.select("doc_id", F.explode(F.array_sort(F.aggregate("c", zero, step, lambda a: a["taken"]))).alias("index"))


def stubs(names: DataFrame, pages: DataFrame) -> DataFrame:
    """(slug, name) of named concepts that no page (slug, name) has by slug or by name."""
    from docloom.functions.text import file_stem

    asked = names.select("name", file_stem(F.col("name")).alias("slug")).dropDuplicates(["slug"])
    return asked.join(pages.select("slug"), "slug", "left_anti").join(pages.select("name"), "name", "left_anti").select("slug", "name")
