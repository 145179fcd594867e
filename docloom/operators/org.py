"""Organisation rollups, activity, permissions and status counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.session import materialize

#: What a role may do.
PERMISSIONS = {"admin": ("read", "write", "delete", "manage"), "editor": ("read", "write"), "viewer": ("read",)}


def members(rows: DataFrame) -> DataFrame:
    """(team, member, role, wiki) with the defaults of a role and a folder."""
    return rows.select("team", "member", F.coalesce("role", F.lit("viewer")).alias("role"), F.coalesce("wiki", F.concat(F.lit("wiki/"), "member")).alias("wiki"))


def rollup(rows: DataFrame) -> DataFrame:
    """(org, team, role, n_members, pages, level): counts of each role, team and the whole."""
    own = rows.withColumn("role", F.coalesce("role", F.lit("viewer")))
    return own.rollup("org", "team", "role").agg(F.count("*").alias("n_members"), F.round(F.sum("pages"), 2).alias("pages"), F.grouping_id().alias("level")).where("org IS NOT NULL")


def activity(rows: DataFrame, limit: int = 50, member: int | None = None, team: int | None = None) -> DataFrame:
    """The last entries of a log (ts, event_id, member, team, action), newest first."""
    if member is not None:
        rows = rows.where(F.col("member") == member)
    if team is not None:
        rows = rows.where(F.col("team") == team)
    return rows.orderBy(F.desc("ts"), "event_id").limit(limit).select("event_id", "member", "team", "action")


def allowed(rows: DataFrame, permission: str) -> DataFrame:
    """(member, role, allowed): by the first row of each member in order of team."""
    first = rows.groupBy("member").agg(F.min(F.struct("team", F.coalesce("role", F.lit("viewer")).alias("role"))).alias("f")).select("member", F.col("f.role").alias("role"))
    roles = [r for r, p in PERMISSIONS.items() if permission in p]
    return first.withColumn("allowed", F.col("role").isin(*roles))


def status(pages: DataFrame) -> DataFrame:
    """(section, n, stubs): pages by section, with those that name a stub status anywhere."""
    return pages.groupBy("section").agg(F.count("*").alias("n"), F.count_if(F.col("content").contains("status: stub")).alias("stubs"))


def human_sizes(files: DataFrame) -> DataFrame:
    """Files (path, size) with the size in words."""
    size = F.when(F.col("size") < 1024, F.concat(F.col("size").cast("string"), F.lit(" B"))).when(F.col("size") < 1 << 20, F.format_string("%.1f KB", F.col("size") / 1024)).otherwise(F.format_string("%.1f MB", F.col("size") / (1 << 20)))
    return files.select("path", size.alias("shown"))


def shared_pages(pages: DataFrame) -> DataFrame:
    """(slug, n_versions, content): pages (member, slug, content) of all members; several versions stand under their members' names."""
    versions = F.array_sort(F.collect_list(F.struct("member", "content")))
    rows = pages.groupBy("slug").agg(versions.alias("v"))
    many = F.array_join(F.transform("v", lambda x: F.concat(F.lit("## "), x["member"], F.lit("의 버전\n\n"), x["content"])), "\n\n")
    return rows.select("slug", F.size("v").cast("long").alias("n_versions"), F.when(F.size("v") == 1, F.col("v")[0]["content"]).otherwise(many).alias("content"))


def title_order(title: Column, collation: str = "ko") -> Column:
    """What titles are ordered by: marks and digits, then Hangul and Han, then Latin, as a Korean reader expects."""
    return F.collate(title, collation)


def placed_by_title(rows: DataFrame) -> DataFrame:
    """Rows (title) with their place from 1 in the order of titles: places within ranges of titles, and the sizes of the ranges before."""
    order = [title_order(F.col("title")), F.col("title")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    ranged = materialize(ranged.withColumns({"_part": F.shiftright(at, 33), "_n": at.bitwiseAND((1 << 33) - 1)}), "titles")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_size"))
    before = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"))  # one row for each range
    return ranged.join(F.broadcast(before), "_part").select(*rows.columns, (F.col("_before") + F.col("_n") + 1).cast("int").alias("pos"))


def top_by_title(concepts: DataFrame, n: int = 10) -> DataFrame:
    """(slug, title, total): the first concepts by title in Korean order, with how many there are."""
    total = concepts.agg(F.count("*").alias("total"))
    return concepts.orderBy(title_order(F.col("title")), "title", "slug").limit(n).crossJoin(F.broadcast(total)).select("slug", "title", "total")  # total is one row


def sessions(rows: DataFrame, gap: float) -> DataFrame:
    """(member, session, n): a member's log cut where it pauses for longer than gap seconds."""
    own = Window.partitionBy("member").orderBy("ts", "event_id")
    new = (F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(own)) > gap * 1e6).cast("int")
    return rows.withColumn("session", F.sum(F.coalesce(new, F.lit(0))).over(own)).groupBy("member", "session").agg(F.count("*").alias("n"))
