"""Pages that are written anew: backlinks, deletions, sources, conflict notices, related sections and the exported graph.

Pages are (slug, content). Each function returns new contents; nothing is
changed in place, so a repeated run writes the same pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.frontmatter import items, quoted, raw_values
from docloom.functions.text import body, once
from docloom.operators.links import links

#: The section of related concepts, and the words for relations.
RELATED = "관련 개념"
WORDS = {"parent": "상위 개념", "child": "하위 개념", "related": "관련 개념", "conflict": "상충 개념"}
_BLANK = " \n\t\r"


def meta(text: Column) -> Column:
    """The front matter as a map from keys to their values as they are written, lists with their lines; the last of repeated keys counts; empty without front matter."""
    return raw_values(text)


def dumped(values: Column, content: Column) -> Column:
    """A page of a map of front matter, its keys sorted, and a body."""

    def lines(own: Column) -> Column:
        line = lambda k: F.concat(k, F.lit(":"), F.when(own[k].startswith("\n"), own[k]).when(own[k] == "", "").otherwise(F.concat(F.lit(" "), own[k])))
        return F.array_join(F.transform(F.array_sort(F.map_keys(own)), line), "\n")

    return F.concat(F.lit("---\n"), once(values, lines), F.lit("\n---\n\n"), content)


def with_values(values: Column, new: dict[str, Column]) -> Column:
    """A map with some values set."""
    names = list(new)
    rest = F.map_filter(values, lambda k, v: ~k.isin(*names))
    return F.map_concat(rest, F.create_map(*[x for k, v in new.items() for x in (F.lit(k), v)]))


def block(values: Column) -> Column:
    """An array as a list of front matter."""
    return F.concat(F.lit("\n"), F.array_join(F.transform(values, lambda x: F.concat(F.lit("- "), quoted(x))), "\n"))


def with_source(text: Column, source: Column, date: str) -> Column:
    """The page with one more source file, once, and a new date."""

    def values(own: Column) -> Column:
        files = F.array_union(items(F.coalesce(own["source_files"], F.lit(""))), F.array(source))
        return with_values(own, {"source_files": block(files), "last_updated": F.lit(date)})

    return dumped(once(meta(text), values), body(text))


def with_notice(text: Column, source: Column, report: Column) -> Column:
    """The page with a notice of a conflict on top."""
    notice = F.concat(F.lit("> ⚠️ **충돌 감지됨** — `"), source, F.lit("` 과 내용이 상충합니다.\n> 충돌 보고: `"), report, F.lit("`\n\n"))
    return dumped(meta(text), F.concat(notice, body(text)))


def with_section(text: Column, heading: str, section: Column) -> Column:
    """A text in which a second-level section is replaced, or added at the end."""

    def made(parts: Column) -> Column:
        rest = F.get(parts, F.lit(1))
        at = F.locate("\n##", rest)
        tail = F.when(at > 0, F.substr(rest, at)).otherwise("")
        return F.when(F.size(parts) > 1, F.concat(parts[0], section, F.lit("\n\n"), tail)).otherwise(F.concat(F.rtrim(parts[0], F.lit(_BLANK)), F.lit("\n\n"), section, F.lit("\n")))

    return once(F.split(text, rf"##(?<![^\n]##)[ ]*{heading}[ ]*\n", 2), made)  # the marks first: looking behind each character takes long


def with_entries(text: Column, entries: Column) -> Column:
    """A text with lines added at the end of its related section, which is added if it isn't there."""
    mark = rf"(?:^|\n)##[ \t]+{RELATED}[ \t]*(?=\n|\z)"
    upto = F.regexp_extract(text, rf"(?s)^(.*?{mark}.*?)(?:\n##[ \t]+.*)?\z", 1)
    rest = F.substring(text, F.length(upto) + 1, F.length(text))
    own = F.concat(F.rtrim(upto, F.lit(_BLANK)), F.lit("\n"), entries, F.when(rest == "", "\n").otherwise(F.concat(F.lit("\n"), rest)))
    return F.when(text.rlike(mark), own).otherwise(F.concat(F.rtrim(text, F.lit(_BLANK)), F.lit(f"\n\n## {RELATED}\n"), entries, F.lit("\n")))


def with_backlinks(pages: DataFrame, relation: str = "역참조") -> DataFrame:
    """(slug, n_inserted, content) of the pages that other pages link to without a link back by slug; each gets a line for each such page, by slug."""
    each = links(pages).where("slug <> target").select(F.col("slug").alias("source"), F.col("target").alias("slug")).distinct()
    back = pages.select(F.col("slug").alias("slug"), F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"\[\[([^\[\]]+)\]\]"), F.lit(1)))).alias("source"))
    new = each.join(back, ["slug", "source"], "left_anti")
    lines = new.groupBy("slug").agg(F.count("*").alias("n_inserted"), F.array_join(F.transform(F.array_sort(F.collect_list("source")), lambda x: F.concat(F.lit("- [["), x, F.lit(f"]] — {relation}"))), "\n").alias("entries"))
    return pages.select("slug", "content").join(lines, "slug").select("slug", "n_inserted", with_entries(F.col("content"), F.col("entries")).alias("content"))


def without_pages(pages: DataFrame, gone: DataFrame) -> DataFrame:
    """(slug, n_removed, content) of the pages that stay when some (slug) go: lines that begin with a link to one of these are blanked."""
    named = r"^\s*[-•]?\s*(?:→\s*)?\[\[([^\]|]+)\]\]"
    rows = pages.select("slug", "content").join(gone.select("slug"), "slug", "left_anti")
    first = F.transform(F.split("content", "\n"), lambda x: F.regexp_extract(x, named, 1))
    names = rows.select("slug", F.explode(F.array_distinct(F.filter(first, lambda x: x != ""))).alias("name"))
    hit = names.join(gone.select(F.col("slug").alias("name")), "name", "left_semi").groupBy("slug").agg(F.collect_list("name").alias("names"))
    lines = F.transform(F.split("content", "\n"), lambda x: F.when(F.array_contains("names", F.regexp_extract(x, named, 1)), "").otherwise(x))
    n = F.size(F.filter(F.split("content", "\n"), lambda x: F.array_contains("names", F.regexp_extract(x, named, 1))))
    out = rows.join(hit, "slug", "left")
    return out.select("slug", F.when(F.col("names").isNull(), 0).otherwise(n).cast("long").alias("n_removed"), F.when(F.col("names").isNull(), F.col("content")).otherwise(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n")).alias("content"))


def with_related(pages: DataFrame, relations: DataFrame, date: str) -> DataFrame:
    """(slug, content) of the pages (slug, name, content) with relations (source, target, type): front matter and the related section name them by type, then target; an unknown type is related."""
    names = pages.select(F.col("slug").alias("target"), "name")
    relations = relations.withColumn("type", F.when(F.col("type").isin(*WORDS), F.col("type")).otherwise("related"))
    word = F.create_map(*[F.lit(x) for kv in WORDS.items() for x in kv])[F.col("type")]
    rows = relations.join(names, "target").select(F.col("source").alias("slug"), F.struct("type", "target", F.col("name").alias("other"), word.alias("word")).alias("r"))
    each = rows.groupBy("slug").agg(F.array_sort(F.collect_set("r")).alias("r"))
    lines = F.array_join(F.transform("r", lambda x: F.concat(F.lit("- [["), x["target"], F.lit("|"), x["other"], F.lit("]] — "), x["word"])), "\n")
    values = F.concat(F.lit("\n"), F.array_join(F.transform("r", lambda x: F.concat(F.lit("- name: "), x["other"], F.lit("\n  slug: "), x["target"], F.lit("\n  type: "), x["type"])), "\n"))
    out = pages.select("slug", "content").join(each, "slug")
    new = with_section(body(F.col("content")), RELATED, F.concat(F.lit(f"## {RELATED}\n\n"), lines))
    return out.select("slug", dumped(with_values(meta(F.col("content")), {"related_concepts": values, "last_updated": F.lit(date)}), new).alias("content"))


def typed_edges(pages: DataFrame, relations: DataFrame) -> DataFrame:
    """(source, target, type): one edge for each unordered pair of known pages, of links and of relations (seq, source, target, type).

    A link has the type of the last relation in its direction. A typed edge goes
    before an untyped one, links before relations, then by place.
    """
    known = pages.select("slug")
    typed = relations.groupBy("source", "target").agg(F.max(F.struct("seq", "type")).alias("t"), F.min("seq").alias("at"))
    for end in ("source", "target"):
        typed = typed.join(known.withColumnRenamed("slug", end), end, "left_semi")
    linked = links(pages).where("slug <> target").join(known.withColumnRenamed("slug", "target"), "target", "left_semi").groupBy(F.col("slug").alias("source"), "target").agg(F.min("pos").cast("long").alias("pos"))
    both = linked.join(typed, ["source", "target"], "full").where("source <> target")
    order = F.struct(F.col("t").isNull().alias("untyped"), F.col("pos").isNull().alias("unlinked"), F.when(F.col("pos").isNotNull(), F.col("source")).alias("file"), F.coalesce("pos", "at").alias("at"), "source", "target", F.col("t.type").alias("type"))
    best = both.groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.min(order).alias("o"))
    return best.select("o.source", "o.target", "o.type")


def graph_lines(concepts: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, id, json): the exported graph as a line for each node (slug, name) and each edge (source, target, type), to be written as text."""
    node = F.to_json(F.struct(F.col("slug").alias("id"), "name", F.lit("concept").alias("group")))
    nodes = concepts.select(F.lit("node").alias("kind"), F.col("slug").alias("id"), node.alias("json"))
    edge = F.to_json(F.struct("source", "target", "type"))
    return nodes.union(edges.select(F.lit("edge"), F.concat_ws(">", "source", "target"), edge))
