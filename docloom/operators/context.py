"""Relevance-ranked contexts under a token budget."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import estimate_tokens, first_paragraph, question_words, relevance
from docloom.session import materialize


def scored(docs: DataFrame, question: str, text: Column, stem: Column) -> DataFrame:
    """docs with their score for a question."""
    return docs.withColumn("score", relevance(question_words(question), text, stem))


#: So many rows of a ranking are a block, and at most so many blocks are read at once.
BLOCK, AHEAD = 1024, 64


@dataclass(frozen=True)
class Ranking:
    """Rows in order, written once: rows (id, rank, costs..., pos, block) and blocks (block, least of each cost)."""

    rows: DataFrame
    blocks: DataFrame


def ranking(rows: DataFrame, costs: list[str]) -> Ranking:
    """Sort rows (id, rank, costs...) by rank, then id, once; a block is a stretch of them with the least of each cost."""
    placed = rows.repartitionByRange("rank", "id").sortWithinPartitions("rank", "id").withColumn("pos", F.monotonically_increasing_id())
    placed = materialize(placed.withColumn("block", F.shiftright("pos", BLOCK.bit_length() - 1)), "ranking")
    return Ranking(placed, materialize(placed.groupBy("block").agg(*[F.min(c).alias(c) for c in costs]), "blocks"))


def fold(r: Ranking, cost: str, budget: int) -> list[tuple[int, int, int]]:
    """(pos, cost, remaining) of the rows that a budget takes, in order.

    A row is taken if its own cost fits what is left, and scanning goes on after one
    that doesn't. Only blocks that hold a fitting row are read, at most 64 at a time and
    of these only fitting rows; from each block read for the first time at least one row is taken, so with costs of at
    least 1 there are no more of them than the budget.
    """
    left, taken, last, ahead = budget, [], -1, 1
    while left > 0:
        near = [x["block"] for x in r.blocks.where((F.col("block") > last) & (F.col(cost) <= left)).orderBy("block").limit(ahead).collect()]
        if not near:
            break
        for x in r.rows.where(F.col("block").isin(near) & (F.col(cost) <= left)).select("pos", F.col(cost).alias("cost")).orderBy("pos").collect():
            if 0 < left >= x["cost"]:
                left -= x["cost"]
                taken.append((x["pos"], x["cost"], left))
        last, ahead = near[-1], min(2 * ahead, AHEAD)
    return taken


def greedy(rows: DataFrame, budget: int) -> DataFrame:
    """(id, rank, tokens, remaining) of rows (id, rank, tokens) that a budget takes in order of rank, then id."""
    r = ranking(rows.select("id", "rank", "tokens"), ["tokens"])
    return _taken(r, fold(r, "tokens", budget)).select("id", "rank", "tokens", "remaining")


def _taken(r: Ranking, taken: list[tuple[int, int, int]]) -> DataFrame:
    """The ranking's rows that were taken, as many as a budget has tokens at most."""
    found = r.rows.sparkSession.createDataFrame(taken, "pos long, tokens long, remaining long")
    return r.rows.drop("tokens").join(F.broadcast(found), "pos")


def context(docs: DataFrame, question: str, budget: int, body: Column | None = None) -> DataFrame:
    """(doc_id, score, tokens, remaining): documents (doc_id, text, stem) in a context, best first.

    ``body``: what of a document is shown (and paid for), the text by default.
    """
    rows = scored(docs, question, F.col("text"), F.col("stem")).where("score > 0")
    rows = rows.select(F.col("doc_id").alias("id"), (-F.col("score")).alias("rank"), estimate_tokens(F.col("text") if body is None else body).alias("tokens"))
    return greedy(rows, budget).select(F.col("id").alias("doc_id"), F.round(-F.col("rank"), 6).alias("score"), "tokens", "remaining")


def levels(docs: DataFrame, question: str, budget: int, first: Column) -> DataFrame:
    """(level, n_scored, n_used, tokens): whole texts, then first paragraphs, then names, up to the level that skips nothing; one ranking serves all."""
    rows = scored(docs, question, F.col("text"), F.col("stem")).where("score > 0")
    bodies = (F.col("text"), first, F.col("stem"))
    r = ranking(rows.select(F.col("doc_id").alias("id"), (-F.col("score")).alias("rank"), *[estimate_tokens(b).alias(f"t{k}") for k, b in enumerate(bodies)]), [f"t{k}" for k in range(len(bodies))])
    n, out = r.rows.count(), []
    for level in range(len(bodies)):
        used = fold(r, f"t{level}", budget)
        out.append((level, n, len(used), sum(t for _, t, _ in used)))
        if len(used) == n:
            break
    return docs.sparkSession.createDataFrame(out, "level int, n_scored long, n_used long, tokens long")


#: Kinds of pages in the order in which a context takes them.
KINDS = ("index", "concept", "exploration")
MODES = ("full", "first_para", "summaries_only")


def assembled(pages: DataFrame, question: str, budget: int, mode: str = "full") -> DataFrame:
    """(id, kind, score, tokens, decision, remaining): what becomes of each page (id, kind, text, stem) in a context.

    Index pages come first whatever their score, then concepts and explorations with
    a score above 0, best first. ``first_para`` shows and charges a concept's first
    paragraph; ``summaries_only`` leaves concepts out, as compressed. A page is used, skipped
    (looked at, but larger than what was left), or compressed; pages after the budget's end have no row.
    A page of another or no kind has none either; null texts are empty.
    """
    if mode not in MODES:
        raise ValueError(f"no mode {mode}")
    text = F.coalesce("text", F.lit(""))
    rows = scored(pages.where(F.col("kind").isin(*KINDS)).withColumn("text", text), question, F.col("text"), F.col("stem")).where("score > 0 OR kind = 'index'")
    shown = F.when(F.col("kind") == "concept", F.coalesce(first_paragraph(F.col("text")), F.lit(""))).otherwise(F.col("text")) if mode == "first_para" else F.col("text")
    priority = F.array_position(F.lit(list(KINDS)), F.col("kind"))
    rank = F.struct(priority.alias("priority"), F.when(F.col("kind") == "index", 0.0).otherwise(-F.col("score")).alias("score"))
    rows = rows.select("id", rank.alias("rank"), "kind", "score", estimate_tokens(shown).alias("tokens"))
    left_out = rows.where("kind = 'concept'") if mode == "summaries_only" else rows.limit(0)
    r = ranking(rows.where("kind <> 'concept'") if mode == "summaries_only" else rows, ["tokens"])
    used = fold(r, "tokens", budget)
    last = used[-1][0] if used and used[-1][2] <= 0 else None
    taken = r.rows.sparkSession.createDataFrame(used, "pos long, _tokens long, remaining long")
    seen = (r.rows if last is None else r.rows.where(F.col("pos") <= last)).join(F.broadcast(taken), "pos", "left")  # at most as many as the budget's tokens
    out = seen.select("id", "kind", "score", "tokens", F.when(F.col("remaining").isNull(), "skipped").otherwise("used").alias("decision"), "remaining")
    return out.unionByName(left_out.select("id", "kind", "score", "tokens", F.lit("compressed").alias("decision"), F.lit(None).cast("long").alias("remaining")))


def answer_mode(pages: DataFrame, question: str, budget: int) -> tuple[str, DataFrame]:
    """The first mode that skips nothing, else the last, and its decisions."""
    for mode in MODES:
        out = materialize(assembled(pages, question, budget, mode), mode)
        if mode == MODES[-1] or out.where("decision = 'skipped'").limit(1).count() == 0:
            break
    return mode, out


def decomposed(docs: DataFrame, questions: list[str], budget: int) -> DataFrame:
    """(doc_id, n_questions): the documents that the contexts of partial questions use."""
    used = [context(docs, q, budget).select("doc_id") for q in questions]
    out = used[0]
    for u in used[1:]:
        out = out.union(u)
    return out.groupBy("doc_id").agg(F.count("*").alias("n_questions"))


def new_gaps(gaps: DataFrame, existing: DataFrame) -> DataFrame:
    """Gaps (gap) that no line of the existing list (text) equals or holds as a whole word sequence.

    Both are cut into words; a gap's first word is what is joined, so only lines
    that have it are looked at.
    """
    words = lambda c: F.split(F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " ")), " ")
    asked = gaps.select("gap", F.array_join(words("gap"), " ").alias("key"), words("gap")[0].alias("w"))
    lines = existing.select(F.array_join(words("text"), " ").alias("line"), F.explode(F.array_distinct(words("text"))).alias("w"))
    known = asked.join(lines, "w").where(F.concat(F.lit(" "), "line", F.lit(" ")).contains(F.concat(F.lit(" "), F.col("key"), F.lit(" ")))).select("gap").distinct()
    return asked.select("gap").distinct().join(known, "gap", "left_anti")


def ontology(communities: DataFrame, concepts: DataFrame, question: str, budget: int, most_communities: int = 5, most_concepts: int = 3) -> DataFrame:
    """(kind, name, tokens, remaining): the graph's part of a context, of communities and concepts (name, text).

    The best communities come first, each if it fits; then the best concepts by
    their names with what is left.
    """
    words = question_words(question)
    best = lambda df, text, n: df.withColumn("score", relevance(words, text, F.col("name"))).where("score > 0").orderBy(F.desc("score"), "name").limit(n)
    rows = lambda df: df.select(F.col("name").alias("id"), (-F.col("score")).alias("rank"), estimate_tokens(F.col("text")).alias("tokens"))
    first = greedy(rows(best(communities, F.col("text"), most_communities)), budget)
    left = budget - (first.agg(F.sum("tokens")).first()[0] or 0)
    second = greedy(rows(best(concepts, F.col("name"), most_concepts)), left)
    part = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.col("id").alias("name"), "tokens", "remaining")
    return part(first, "community").union(part(second, "concept"))
