"""The property graph: statements to edges, traversals, communities and statistics.

Edges are (predicate, src, dst, weight, reason). Traversals take walks: on a
cycle the start may come back.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import estimate_tokens, render
from docloom.operators.compiling import mapped
from docloom.operators.components import components
from docloom.session import materialize

#: The predicates that a graph takes.
PREDICATES = ("IS_A", "PART_OF", "ENABLES", "REQUIRES", "PRECEDES", "CO_OCCURS", "CONTRADICTS", "EXEMPLIFIES", "BELONGS_TO")


def edges(triples: DataFrame) -> DataFrame:
    """Statements with all parts and a known predicate; of repeats the last one counts."""
    rows = triples.withColumns({c: F.trim(c) for c in ("subject", "predicate", "object")}).where("subject <> '' AND object <> ''").where(F.col("predicate").isin(*PREDICATES))
    last = rows.groupBy("predicate", "subject", "object").agg(F.max(F.struct("seq", "confidence", "reason")).alias("last"))
    weight = F.when(F.col("predicate") == "CO_OCCURS", F.least(F.greatest(F.coalesce("last.confidence", F.lit(0.7)), F.lit(0.0)), F.lit(1.0)))
    reason = F.when(F.col("predicate") == "CONTRADICTS", F.coalesce("last.reason", F.lit("")))
    return last.select("predicate", F.col("subject").alias("src"), F.col("object").alias("dst"), weight.alias("weight"), reason.alias("reason"))


def load_report(triples: DataFrame) -> DataFrame:
    """(n_nodes, n_edges, n_skipped) of loading the statements."""
    e = edges(triples)
    nodes = e.select(F.explode(F.array("src", "dst")).alias("n")).distinct().agg(F.count("*").alias("n_nodes"))
    blank = (F.trim("subject") == "") | (F.trim("object") == "") | ~F.trim("predicate").isin(*PREDICATES)
    skipped = triples.agg(F.count_if(blank).alias("n_skipped"))
    return nodes.crossJoin(e.agg(F.count("*").alias("n_edges"))).crossJoin(skipped)  # one row each


def nodes(concepts: DataFrame, e: DataFrame) -> DataFrame:
    """(name, summary): all ends of edges, with a concept's non-empty summary where there is one."""
    ends = e.select(F.explode(F.array("src", "dst")).alias("name")).distinct()
    known = concepts.where("summary <> ''").groupBy("name").agg(F.max("summary").alias("summary"))
    return ends.join(known, "name", "left").select("name", F.coalesce("summary", F.lit("")).alias("summary"))


def reach(e: DataFrame, predicates: list[str], depth: int, least: int = 1, starts: DataFrame | None = None, undirected: bool = False) -> DataFrame:
    """(start, node, hops): nodes within least to depth hops, with the fewest hops of those.

    Each hop joins distinct (start, node) pairs, so walks don't multiply.
    """
    step = e.where(F.col("predicate").isin(*predicates)).select("src", "dst").distinct()
    if undirected:
        step = step.union(step.select("dst", "src")).distinct()
    step = materialize(step, "steps")  # each hop reads it
    at = step.select(F.col("src").alias("start"), F.col("dst").alias("node"))
    if starts is not None:
        at = at.join(starts, "start", "left_semi")
    found = [at.withColumn("hops", F.lit(1))]
    for hop in range(2, depth + 1):
        at = at.join(step, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        found.append(at.withColumn("hops", F.lit(hop)))
    return reduce(DataFrame.unionByName, found[least - 1 :]).groupBy("start", "node").agg(F.min("hops").alias("hops"))


def neighbours(e: DataFrame, predicate: str, min_weight: float | None = None) -> DataFrame:
    """(name, other, weight, reason) over edges of a predicate in both directions."""
    own = e.where(F.col("predicate") == predicate)
    if min_weight is not None:
        own = own.where(F.col("weight") >= min_weight)
    there, back = own.select(F.col("src").alias("name"), F.col("dst").alias("other"), "weight", "reason"), own.select(F.col("dst").alias("name"), F.col("src").alias("other"), "weight", "reason")
    return there.union(back).groupBy("name", "other").agg(F.max("weight").alias("weight"), F.max("reason").alias("reason"))


def profile(e: DataFrame) -> DataFrame:
    """(name, parents, children, enables, requires, contradicts, examples): how many of each a node has."""
    out, into = e.select(F.col("src").alias("name"), "predicate", F.lit(True).alias("out")), e.select(F.col("dst").alias("name"), "predicate", F.lit(False).alias("out"))
    up = F.col("predicate").isin("IS_A", "PART_OF")
    count = lambda c: F.count_if(c)
    return out.union(into).groupBy("name").agg(
        count(up & F.col("out")).alias("parents"), count(up & ~F.col("out")).alias("children"), count((F.col("predicate") == "ENABLES") & F.col("out")).alias("enables"),
        count((F.col("predicate") == "REQUIRES") & F.col("out")).alias("requires"), count(F.col("predicate") == "CONTRADICTS").alias("contradicts"), count((F.col("predicate") == "EXEMPLIFIES") & F.col("out")).alias("examples"),
    )


def statistics(e: DataFrame) -> DataFrame:
    """(predicate, n): edges of each predicate, 0 included, and TOTAL."""
    known = e.sparkSession.createDataFrame([(p,) for p in PREDICATES], "predicate string")
    counts = e.groupBy("predicate").agg(F.count("*").alias("n"))
    each = known.join(counts, "predicate", "left").select("predicate", F.coalesce("n", F.lit(0)).alias("n"))
    return each.union(each.agg(F.lit("TOTAL"), F.sum("n")))


def communities(e: DataFrame, min_size: int = 3) -> DataFrame:
    """(community, size, first, last): components over CO_OCCURS with at least min_size members, named by their least."""
    own = e.where("predicate = 'CO_OCCURS'").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    found = components(materialize(own, "co-occurs"))
    return found.groupBy(F.col("component").alias("community")).agg(F.count("*").alias("size"), F.min("node").alias("first"), F.max("node").alias("last")).where(F.col("size") >= min_size)


#: A summary's prompt, and what stands for it without an answer. Fixed values.
SUMMARY_PROMPT = "다음 개념 클러스터를 한 문단(2~4문장)으로 요약하세요. 클러스터의 공통 주제와 개념 간 관계를 설명하세요.\n\n개념 목록: {{ concepts }}"
NO_SUMMARY = "개념 클러스터: "


def community_summaries(labels: DataFrame, completion: Callable[[list[str]], list[str]], budget: int = 2000, min_size: int = 3) -> DataFrame:
    """(community, size, shown, members, summary) of members (node, component): each community's names in order, up to a prompt's budget of tokens, and what a model says about them.

    A community may hold any number of nodes: a name has a token at least, so the first
    ``budget`` names of each of 64 parts, then of these, are all that a prompt can hold.
    A blank answer, or a model that fails, is replaced by the names.
    """
    sizes = labels.groupBy("component").agg(F.count("*").alias("size")).where(F.col("size") >= min_size)
    own = labels.select("component", "node", F.pmod(F.xxhash64("node"), F.lit(64)).alias("part"))
    first = lambda *keys: F.row_number().over(Window.partitionBy("component", *keys).orderBy("node"))
    few = own.withColumn("rank", first("part")).where(F.col("rank") <= budget).withColumn("rank", first()).where(F.col("rank") <= budget)
    used = F.sum(estimate_tokens(F.concat("node", F.lit(", ")))).over(Window.partitionBy("component").orderBy("node").rowsBetween(Window.unboundedPreceding, 0))
    kept = few.withColumn("used", used).where((F.col("used") <= budget) | (F.col("rank") == 1))
    names = kept.groupBy("component").agg(F.array_sort(F.collect_list("node")).alias("members")).join(sizes, "component")
    asked = names.select(F.col("component").alias("community"), "size", F.size("members").alias("shown"), F.array_join("members", ", ").alias("members"))

    def answered(prompts: list[str]) -> list[str]:
        try:
            return completion(prompts)
        except Exception:  # noqa: BLE001  one by one, so that one failure is one community's
            return [_one(completion, p) for p in prompts]

    said = mapped(asked, render(SUMMARY_PROMPT, {"concepts": F.col("members")}), answered, ["community", "size", "shown", "members"])
    return said.select("community", "size", "shown", "members", F.when(F.trim(F.coalesce("answer", F.lit(""))) == "", F.concat(F.lit(NO_SUMMARY), "members")).otherwise(F.trim("answer")).alias("summary"))


def _one(completion: Callable[[list[str]], list[str]], prompt: str) -> str:
    try:
        return completion([prompt])[0]
    except Exception:  # noqa: BLE001
        return ""


def expansion(e: DataFrame, most: int = 5, most_contradictions: int = 3) -> DataFrame:
    """(name, parents, children, enables, requires, contradicts): the first few neighbours of each kind, by name."""
    kinds = {
        "parents": (F.col("predicate").isin("IS_A", "PART_OF"), "src", "dst", most), "children": (F.col("predicate").isin("IS_A", "PART_OF"), "dst", "src", most),
        "enables": (F.col("predicate") == "ENABLES", "src", "dst", most), "requires": (F.col("predicate") == "REQUIRES", "src", "dst", most),
    }
    rows = [e.where(c).select(F.col(a).alias("name"), F.lit(k).alias("kind"), F.col(b).alias("other")) for k, (c, a, b, _) in kinds.items()]
    rows.append(neighbours(e, "CONTRADICTS").select("name", F.lit("contradicts"), "other"))
    both = reduce(DataFrame.union, rows).distinct()
    # a node may have any number of neighbours: the first few of each of 64 parts, then of these
    by = lambda *extra: F.row_number().over(Window.partitionBy("name", "kind", *extra).orderBy("other"))
    some = both.withColumn("part", F.pmod(F.xxhash64("other"), F.lit(64))).withColumn("rank", by("part")).where(F.col("rank") <= most)
    few = some.withColumn("rank", by()).where((F.col("rank") <= most) & ((F.col("kind") != "contradicts") | (F.col("rank") <= most_contradictions)))
    own = lambda k: F.array_join(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("other")))), ",").alias(k)
    return few.groupBy("name").agg(*[own(k) for k in [*kinds, "contradicts"]])


def communities_with(labels: DataFrame, text: str) -> DataFrame:
    """(community, size, matches): communities (node, component) with a member whose name holds a text."""
    hit = F.lower("node").contains(text.lower())
    return labels.groupBy(F.col("component").alias("community")).agg(F.count("*").alias("size"), F.count_if(hit).alias("matches")).where("matches > 0")
