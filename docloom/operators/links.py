"""Wiki links, backlinks, lineage by source, renames, deletes and the export graph.

Pages are (doc_id, slug, content). A link's target is named by its title, which
becomes a slug with underscores for spaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Links without and with their alias.
LINK = r"\[\[([^\]|#]+?)(?:\|[^\]]+)?\]\]"
LINK_WITH_ALIAS = r"\[\[([^\[\]]+)\]\]"


def links(pages: DataFrame, keep_alias: bool = False) -> DataFrame:
    """(slug, pos, target): every occurrence of a link, in order; with aliases each distinct name once."""
    found = F.regexp_extract_all("content", F.lit(LINK_WITH_ALIAS if keep_alias else LINK), F.lit(1))
    rows = pages.select("slug", F.posexplode(F.array_distinct(found) if keep_alias else found).alias("pos", "name"))
    return rows.select("slug", "pos", (F.col("name") if keep_alias else F.replace(F.trim("name"), F.lit(" "), F.lit("_"))).alias("target"))


def missing_backlinks(pages: DataFrame) -> DataFrame:
    """(source, target) of links to other pages that don't link back."""
    each = links(pages).select("slug", "target").distinct().where("slug <> target")
    there = each.join(pages.select(F.col("slug").alias("target")), "target", "left_semi")
    back = each.select(F.col("slug").alias("target"), F.col("target").alias("slug"))
    return there.join(back, ["slug", "target"], "left_anti").select(F.col("slug").alias("source"), "target")


def unresolved(pages: DataFrame) -> DataFrame:
    """(target, n_files, files): links without a page, with the files that have them."""
    each = links(pages).select("slug", "target").distinct()
    return each.join(pages.select(F.col("slug").alias("target")), "target", "left_anti").groupBy("target").agg(F.count("*").alias("n_files"), F.array_join(F.array_sort(F.collect_list("slug")), ",").alias("files"))


def source_index(concepts: DataFrame) -> DataFrame:
    """(source, n, first, last): the concepts of each source file; backslashes are slashes."""
    rows = concepts.select(F.replace("source_file", F.lit("\\"), F.lit("/")).alias("source"), "slug").distinct()
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.min("slug").alias("first"), F.max("slug").alias("last"))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def related(concepts: DataFrame, sources: DataFrame, match: str = "exact") -> DataFrame:
    """(source, slug) of concepts compiled from the given sources: by exact path, by path suffix or by base name.

    A suffix match shares the base name, which is what is joined.
    """
    files = concepts.select("slug", F.col("source_file").alias("file"))
    if match == "exact":
        return sources.join(files, F.col("source") == F.col("file")).select("source", "slug")
    both = sources.withColumn("name", basename(F.col("source"))).join(files.withColumn("name", basename(F.col("file"))), "name")
    return (both if match == "basename" else both.where(F.col("file").endswith(F.col("source")))).select("source", "slug")


def deletion(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """(slug, action) of what goes with the sources: their pages, and the pages whose links to them go."""
    from docloom.functions.text import field

    gone = pages.withColumn("source", field(F.col("content"), "source_files")).join(sources, "source", "left_semi").select("slug")
    touched = links(pages).join(gone.select(F.col("slug").alias("target")), "target", "left_semi").select("slug").distinct().join(gone, "slug", "left_anti")
    return gone.distinct().select("slug", F.lit("delete").alias("action")).union(touched.select("slug", F.lit("unlink").alias("action")))


def without_lines(text: Column, name: Column) -> Column:
    """A list without the lines that hold a bullet of the named link, and with blank lines collapsed."""
    kept = F.filter(F.split(text, "\n"), lambda x: ~(F.ltrim(x).startswith("-") & x.contains(F.concat(F.lit("[["), name, F.lit("]]")))))
    return F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n")


def rename(pages: DataFrame, names: DataFrame) -> DataFrame:
    """(slug, n_changed, content) of pages whose links to ``old`` now name ``new``; aliases stay.

    Links are joined with the names one by one; a page's content is put together
    again from the pieces between its links.
    """
    exact = r"\[\[([^\]|]+)(\|[^\]]+)?\]\]"
    pieces = F.split("content", exact, -1)
    rows = pages.select("slug", F.posexplode(F.arrays_zip(pieces.alias("text"), F.regexp_extract_all("content", F.lit(exact), F.lit(1)).alias("name"), F.regexp_extract_all("content", F.lit(exact), F.lit(2)).alias("alias"))).alias("pos", "z")).select("slug", "pos", "z.*")
    rows = rows.join(names, F.col("name") == F.col("old"), "left")
    changed = F.col("old").isNotNull()
    piece = F.concat("text", F.when(F.col("name").isNotNull(), F.concat(F.lit("[["), F.when(changed, F.col("new")).otherwise(F.col("name")), "alias", F.lit("]]"))).otherwise(""))
    out = rows.groupBy("slug").agg(F.sum(changed.cast("long")).alias("n_changed"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", piece.alias("p")))), lambda x: x["p"]), "").alias("content"))
    return out.where("n_changed > 0")


def resolve(pages: DataFrame, names: DataFrame) -> DataFrame:
    """(name, slug, rule) of names: by slug, by slug without case, or by the first heading without case."""
    from docloom.functions.text import first_h1

    low = F.replace(F.lower("name"), F.lit(" "), F.lit("_"))
    keys = [(1, F.col("slug"), F.replace("name", F.lit(" "), F.lit("_"))), (2, F.lower("slug"), low), (3, F.replace(F.lower(first_h1(F.col("content"))), F.lit(" "), F.lit("_")), low)]
    found = None
    for rank, own, asked in keys:
        one = names.withColumn("key", asked).join(pages.select("slug", own.alias("key")), "key").select("name", "slug", F.lit(rank).alias("rule"))
        found = one if found is None else found.union(one)
    return found.groupBy("name").agg(F.min(F.struct("rule", "slug")).alias("best")).select("name", "best.slug", "best.rule")


def export_edges(pages: DataFrame) -> DataFrame:
    """(source, target, n): links to known other pages, by unordered pair with the first direction's ends."""
    known = pages.select(F.col("slug").alias("target"))
    each = links(pages).where("slug <> target").join(known, "target", "left_semi")
    pair = each.select(F.least("slug", "target").alias("a"), F.greatest("slug", "target").alias("b"), "slug", "pos")
    return pair.groupBy("a", "b").agg(F.min(F.struct("slug", "pos")).alias("first"), F.count("*").alias("n")).select(F.col("first.slug").alias("source"), F.when(F.col("first.slug") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("target"), "n")


def export_nodes(pages: DataFrame) -> DataFrame:
    """(slug, link_count, radius): each page's incoming links, counted before pairs are merged."""
    incoming = links(pages).where("slug <> target").groupBy("target").agg(F.count("*").alias("n"))
    rows = pages.select("slug").join(incoming, F.col("slug") == F.col("target"), "left").select("slug", F.coalesce("n", F.lit(0)).alias("link_count"))
    top = rows.agg(F.greatest(F.lit(1), F.max("link_count")).alias("top"))
    return rows.crossJoin(F.broadcast(top)).select("slug", "link_count", F.round(6 + 14 * F.col("link_count") / F.col("top"), 6).alias("radius"))  # top is one row


def quality(pages: DataFrame) -> DataFrame:
    """(rule, slug) of pages that break a rule: no or unclosed front matter, no heading, a broken link."""
    from docloom.functions.text import first_h1, front_matter

    rules = {"front_matter": front_matter(F.col("content")).isNull(), "heading": first_h1(F.col("content")).isNull(), "unclosed_link": F.regexp_replace("content", LINK_WITH_ALIAS, "").contains("[[")}
    broken = F.filter(F.array(*[F.when(v, k) for k, v in rules.items()]), lambda x: x.isNotNull())
    own = pages.select("slug", F.explode(broken).alias("rule")).select("rule", "slug")
    known = pages.select(F.col("slug").alias("target"))
    return own.union(links(pages).join(known, "target", "left_anti").select(F.lit("unresolved_link"), "slug").distinct())


def markdown_links(text: Column) -> Column:
    """Wiki links as Markdown links below /concepts."""
    return F.regexp_replace(text, LINK, "[$1](/concepts/$1)")


def index_page(concepts: DataFrame) -> DataFrame:
    """(pos, name, line): the index's lines by name, from names and the first sentence of summaries."""
    line = F.concat(F.lit("- [["), "name", F.lit("]] — "), F.regexp_extract("summary", r"^([^.]*)", 1))
    ranked = concepts.select("name", line.alias("line"), F.substring("name", 1, 2).alias("shard"))
    # positions by a count of the shards before, so that no task orders all names
    counts = ranked.groupBy("shard").agg(F.count("*").alias("n"))
    before = counts.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return ranked.join(before, "shard").withColumn("pos", F.col("before") + F.row_number().over(Window.partitionBy("shard").orderBy("name"))).select("pos", "name", "line")
