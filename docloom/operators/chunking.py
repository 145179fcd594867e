"""Chunking: sections, paragraphs, next-fit packing, overlap and grouping.

Packing is sequential within a document. It is a fold over the document's own array
where that is short, and jumps over prefix sums where a document has many sections,
which then stay rows (``packing.next_fit``). Null and empty texts give no chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import byte_tail, estimate_tokens, strategy
from docloom.operators.packing import next_fit
from docloom.session import materialize
from docloom.settings import Settings

HEADING = r"(?m)(?=^#{1,3} .+)"
#: Documents of at most so many sections are packed by a fold over an array.
FOLD = 512


def sections(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, title, body, of) of docs (doc_id, content): a section starts at a heading of level 1 to 3 and includes it; ``of``: the document's number of sections.

    Without headings, paragraphs are sections without titles.
    """
    trimmed = lambda x: F.trim(x, F.lit(" \n\t\r"))
    parts = F.when(F.col("content").rlike(r"(?m)^#{1,3} .+"), F.split("content", HEADING)).otherwise(F.split("content", r"\n{2,}"))
    parts = F.filter(F.transform(parts, trimmed), lambda x: F.length(x) > 0)
    rows = docs.select("doc_id", parts.alias("parts")).select("doc_id", F.size("parts").alias("of"), F.posexplode("parts").alias("pos", "body"))
    return rows.select("doc_id", "pos", F.trim(F.regexp_extract("body", r"^#{1,3} ([^\n]+)", 1)).alias("title"), "body", "of")


def _packed(pieces: Column, most: int, joiner: str) -> Column:
    """Greedily join texts while the sum of their tokens stays within most."""
    kind = "struct<done:array<string>,open:string,n:bigint>"
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"), F.lit(0).cast("long").alias("n")).cast(kind)

    def step(acc: Column, x: Column) -> Column:
        n = estimate_tokens(x)
        fits = acc["open"].isNull() | (acc["n"] + n <= most)
        return F.struct(
            F.when(fits, acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])).alias("done"),
            F.when(acc["open"].isNull() | ~fits, x).otherwise(F.concat(acc["open"], F.lit(joiner), x)).alias("open"),
            F.when(fits, acc["n"] + n).otherwise(n).alias("n"),
        ).cast(kind)

    return F.aggregate(pieces, zero, step, lambda acc: F.when(acc["open"].isNull(), acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])))


def split_paragraphs(text: Column, most: int) -> Column:
    """Texts of at most ``most`` tokens from paragraphs; a longer paragraph is split at sentences, and one longer sentence stays whole.

    Paragraphs of a text are packed between the long ones, which stand alone.
    """
    paragraphs = F.filter(F.transform(F.split(text, r"\n{2,}"), lambda x: F.trim(x, F.lit(" \n\t\r"))), lambda x: F.length(x) > 0)
    kind = "struct<done:array<array<string>>,open:array<string>>"
    zero = F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("open")).cast(kind)
    alone = lambda x: _packed(F.split(x, r"(?<=[.!?])\s+"), most, " ")

    def step(acc: Column, x: Column) -> Column:
        closed = F.array_append(acc["done"], _packed(acc["open"], most, "\n\n"))
        long_ = estimate_tokens(x) > most
        return F.struct(F.when(long_, F.array_append(closed, alone(x))).otherwise(acc["done"]).alias("done"), F.when(long_, F.array().cast("array<string>")).otherwise(F.array_append(acc["open"], x)).alias("open")).cast(kind)

    return F.flatten(F.aggregate(paragraphs, zero, step, lambda acc: F.array_append(acc["done"], _packed(acc["open"], most, "\n\n"))))


def room(s: Settings, ratio: float) -> int:
    """Tokens of a chunk's body."""
    return max(int(s.available * ratio) - s.overlap, s.min_chunk)


def pack(parts: DataFrame, most: int) -> DataFrame:
    """(doc_id, chunk, title, body, pos, part, tokens): each section (doc_id, pos, title, body, of) or part of a long section with its chunk's number from 0.

    Sections fill a chunk until the next doesn't fit. The parts of a section
    that is too long alone are chunks of their own.
    """
    tokens = estimate_tokens(F.col("body"))
    units = parts.withColumn("long", tokens > most)
    units = units.select("doc_id", "pos", "title", "of", "long", F.posexplode(F.when(F.col("long"), split_paragraphs(F.col("body"), most)).otherwise(F.array("body"))).alias("part", "body"))
    rows = units.withColumn("tokens", estimate_tokens(F.col("body")))
    return _folded(rows.where(F.col("of") <= FOLD), most).unionByName(_jumped(rows.where(F.col("of") > FOLD), most))


def _folded(rows: DataFrame, most: int) -> DataFrame:
    lists = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "part", "title", "body", "tokens", "long"))).alias("units"))
    kind = "struct<ids:array<bigint>,id:bigint,n:bigint,shut:boolean>"
    zero = F.struct(F.array().cast("array<bigint>").alias("ids"), F.lit(-1).cast("long").alias("id"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("shut")).cast(kind)

    def step(acc: Column, x: Column) -> Column:
        new = acc["shut"] | x["long"] | (acc["n"] + x["tokens"] > most)
        own = F.when(new, acc["id"] + 1).otherwise(acc["id"])
        return F.struct(F.array_append(acc["ids"], own).alias("ids"), own.alias("id"), F.when(new, x["tokens"]).otherwise(acc["n"] + x["tokens"]).alias("n"), x["long"].alias("shut")).cast(kind)

    chunk = F.aggregate("units", zero, step, lambda acc: acc["ids"])
    each = lists.select("doc_id", F.explode(F.arrays_zip(chunk.alias("chunk"), F.col("units").alias("u"))).alias("z"))
    return each.select("doc_id", F.col("z.chunk").alias("chunk"), F.col("z.u.title").alias("title"), F.col("z.u.body").alias("body"), F.col("z.u.pos").alias("pos"), F.col("z.u.part").alias("part"), F.col("z.u.tokens").alias("tokens"))


def _jumped(rows: DataFrame, most: int) -> DataFrame:
    rows = materialize(rows.select("doc_id", "pos", "part", "title", "body", "tokens", "long"), "units")
    empty = F.lit(None).cast("long").alias("chunk")
    if not rows.limit(1).count():
        return rows.select("doc_id", empty, "title", "body", "pos", "part", "tokens")
    n = (F.row_number().over(Window.partitionBy("doc_id").orderBy("pos", "part")) - 1).cast("long")
    placed = materialize(rows.select("doc_id", "pos", "part", "tokens", "long", n.alias("n")), "places")
    bins = next_fit(placed.select(F.col("doc_id").alias("key"), "n", "tokens", F.col("long").alias("alone")), most)
    told = placed.select("doc_id", "pos", "part", "n").join(bins.select(F.col("key").alias("doc_id"), "n", F.col("bin").alias("chunk")), ["doc_id", "n"])
    return rows.join(told, ["doc_id", "pos", "part"]).select("doc_id", "chunk", "title", "body", "pos", "part", "tokens")


def header(name: Column, section: Column, total: Column, index: Column) -> Column:
    """The line that heads a chunk."""
    return F.format_string("[%s / %s / %d개 중 %d번째]", name, section, total, index)


def _assembled(packed: DataFrame, s: Settings, kind: str, level: int) -> DataFrame:
    bodies = packed.groupBy("doc_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("pos", "part", "body", "title"))).alias("u"))
    named = F.filter(F.transform("u", lambda x: x["title"]), lambda t: F.length(t) > 0)
    bodies = bodies.select("doc_id", "chunk", F.array_join(F.transform("u", lambda x: x["body"]), "\n\n").alias("raw"), F.try_element_at(named, F.lit(1)).alias("section"))
    own = Window.partitionBy("doc_id")
    order = own.orderBy("chunk")
    group = F.floor(F.col("chunk") / 2) if level == 2 else F.lit(0)
    tail = byte_tail(F.lag("raw").over(order), 4 * s.overlap)
    return bodies.select("doc_id", F.lit(kind).alias("strategy"), (F.col("chunk") + 1).alias("index"), F.count("*").over(own).alias("total"), F.coalesce("section", F.concat(F.lit("Doc "), F.col("doc_id"))).alias("section"), F.lit(level).alias("level"), group.cast("long").alias("group"), tail.alias("tail"), "raw")


def chunk_documents(docs: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, strategy, index, total, section, level, group, content, token_count) of docs (doc_id, content).

    Short documents are one chunk; longer ones are packed to 0.8, the longest to
    0.4 of the budget and then grouped by two. A chunk begins with its header and
    the end of the body before it.
    """
    rows = docs.where(F.length("content") > 0).withColumn("kind", strategy(estimate_tokens(F.col("content")), s))
    one = rows.where("kind = 'single_pass'").select("doc_id", F.lit("single_pass").alias("strategy"), F.lit(1).cast("long").alias("index"), F.lit(1).cast("long").alias("total"), F.lit("전체").alias("section"), F.lit(1).alias("level"), F.lit(0).cast("long").alias("group"), F.lit(None).cast("string").alias("tail"), F.col("content").alias("raw"))
    mapped = _assembled(pack(sections(rows.where("kind = 'map_reduce'")), room(s, 0.8)), s, "map_reduce", 1)
    tree = _assembled(pack(sections(rows.where("kind = 'hierarchical'")), room(s, 0.4)), s, "hierarchical", 2)
    both = one.unionByName(mapped).unionByName(tree)
    overlap = F.when(F.length("tail") > 0, F.concat(F.lit("<!-- overlap -->\n"), F.col("tail"), F.lit("\n<!-- /overlap -->\n\n"))).otherwise("")
    both = both.withColumn("content", F.concat(header(F.concat(F.lit("Doc "), F.col("doc_id")), F.col("section"), F.col("total"), F.col("index")), F.lit("\n\n"), overlap, F.col("raw")))
    return both.select("doc_id", "strategy", "index", "total", "section", "level", "group", "content", estimate_tokens(F.col("content")).alias("token_count"))


def manifest(chunks: DataFrame) -> DataFrame:
    """One row per document: its strategy, its number of chunks and their files."""
    name = F.format_string("chunk_%04d.md", F.col("index"))
    return chunks.groupBy("doc_id", "strategy").agg(F.count("*").alias("total_chunks"), F.sum("token_count").alias("tokens"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", name.alias("file")))), lambda x: x["file"]), ",").alias("files"))


def merged_at_h2(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, block, n, tokens): sections at second-level headings, joined with the next while they are short.

    A block is closed when it has at least ``least`` tokens.
    """
    parts = F.filter(F.transform(F.split("content", r"(?m)(?=^## )"), lambda x: F.trim(x, F.lit(" \n\t\r"))), lambda x: F.length(x) > 0)
    kind = "struct<done:array<struct<n:int,tokens:bigint>>,n:int,tokens:bigint>"
    zero = F.struct(F.array().cast("array<struct<n:int,tokens:bigint>>").alias("done"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("tokens")).cast(kind)

    def step(acc: Column, x: Column) -> Column:
        n, tokens = acc["n"] + 1, acc["tokens"] + estimate_tokens(x)
        shut = tokens >= least
        return F.struct(F.when(shut, F.array_append(acc["done"], F.struct(n.alias("n"), tokens.alias("tokens")))).otherwise(acc["done"]).alias("done"), F.when(shut, 0).otherwise(n).alias("n"), F.when(shut, 0).otherwise(tokens).cast("long").alias("tokens")).cast(kind)

    blocks = F.aggregate(parts, zero, step, lambda a: F.when(a["n"] > 0, F.array_append(a["done"], F.struct(a["n"].alias("n"), a["tokens"].alias("tokens")))).otherwise(a["done"]))
    return docs.select("doc_id", F.posexplode(blocks).alias("block", "b")).select("doc_id", F.col("block").cast("long").alias("block"), F.col("b.n").cast("long").alias("n"), "b.tokens")
