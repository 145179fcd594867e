"""Heterogeneous sources as rows: web pages, sheets, slides, transcripts, repositories and notes."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


class _Text(HTMLParser):
    """Text of a page as Markdown: headings, paragraphs, list items, tables, links and images; no scripts, styles or navigation."""

    SKIP = {"script", "style", "nav", "noscript", "template"}
    BREAK = {"p", "div", "br", "article", "section", "ul", "ol", "table", "tr", "body", "main", "footer", "header"}
    CELL = {"td", "th"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = 0
        self.href: list[str] = []
        self.tables = 0
        self.rows = 0
        self.cells: list[str] = []
        self.cell: int | None = None  # where the open cell's text begins

    def _end_cell(self) -> None:
        if self.cell is not None:
            text = " ".join("".join(self.out[self.cell :]).split())
            del self.out[self.cell :]
            self.cells.append(text.replace("|", "\\|"))
            self.cell = None

    def _end_row(self) -> None:
        self._end_cell()
        if self.cells:
            self.out.append("\n| " + " | ".join(self.cells) + " |\n")
            if not self.rows:
                self.out.append("|" + "---|" * len(self.cells) + "\n")
            self.rows += 1
            self.cells = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.SKIP:
            self.skip += 1
            return
        if self.skip:
            return
        # a table within a cell is the cell's text
        if tag == "table":
            self.tables += 1
            self.rows = 0 if self.tables == 1 else self.rows
        elif self.tables == 1 and tag == "tr":
            self._end_row()
        elif self.tables == 1 and tag in self.CELL:
            self._end_cell()
            self.cell = len(self.out)
        if tag in self.BREAK or (tag in self.CELL and self.tables > 1):
            self.out.append("\n")
        elif re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            self.out.append("\n- ")
        elif tag == "a":
            self.href.append(dict(attrs).get("href") or "")
            self.out.append("[")
        elif tag == "img":
            a = dict(attrs)
            self.out.append(f"![{a.get('alt') or ''}]({a.get('src') or ''})")

    def handle_endtag(self, tag: str) -> None:
        if tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
            return
        if self.skip:
            return
        if tag == "a" and self.href:
            self.out.append(f"]({self.href.pop()})")
        elif self.tables == 1 and tag in self.CELL:
            self._end_cell()
        elif self.tables == 1 and tag in ("tr", "table"):
            self._end_row()
        if tag == "table":
            self.tables = max(0, self.tables - 1)
        if tag in self.BREAK or re.fullmatch("h[1-6]", tag):
            self.out.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.out.append(re.sub(r"\s+", " ", data))

    def close(self) -> None:
        super().close()
        self._end_row()


#: A page's main part is taken alone if it gives so many characters.
MAIN_LEAST = 200


def _markdown_of(html: str) -> str:
    parser = _Text()
    parser.feed(html)
    parser.close()
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]*\n[ \t]*", "\n", "".join(parser.out))).strip()


def html_to_markdown(html: str | None) -> str:
    """The Markdown of a page's main part, or of the whole page where that is short or missing; an empty text for none."""
    page = re.sub(r"(?s)<head\b.*?</head\s*>", " ", html or "")
    main = re.search(r"(?is)<(main|article)\b.*</\1\s*>", page)
    found = _markdown_of(main[0]) if main else ""
    return found if len(found) >= MAIN_LEAST else max(_markdown_of(page), found, key=len)


@F.pandas_udf(T.StringType())
def _markdown(html: pd.Series) -> pd.Series:
    return html.map(html_to_markdown)


def web_pages(pages: DataFrame) -> DataFrame:
    """(page_id, title, slug, markdown, n_links) of pages (page_id, url, html); the title is the page's, else the address's last part."""
    named = F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    rows = pages.select("page_id", F.when(F.length(named) > 0, named).otherwise(F.regexp_replace(url_slug(F.col("url")), "[-_]+", " ")).alias("title"), url_slug(F.col("url")).alias("slug"), _markdown("html").alias("markdown"))
    return rows.withColumn("markdown", F.regexp_replace("markdown", r"^# [^\n]*\n+", "")).withColumn("n_links", F.size(F.regexp_extract_all("markdown", F.lit(r"\]\([^)]*\)"), F.lit(0))))


def url_slug(url: Column) -> Column:
    """The last part of an address's path, else its host, as a slug."""
    path = F.regexp_replace(F.regexp_replace(url, r"^[a-zA-Z]+://[^/]*", ""), r"[?#].*$", "")
    last = F.regexp_extract(F.regexp_replace(path, r"/+$", ""), r"([^/]+)$", 1)
    host = F.regexp_extract(url, r"^[a-zA-Z]+://([^/:?#]*)", 1)
    own = F.when(F.length(last) > 0, F.regexp_replace(last, r"\.[A-Za-z0-9]{1,5}$", "")).otherwise(host)
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(own), r"[^a-z0-9]+", "-"), r"^-+|-+$", ""), 1, 60)


def local_images(markdown: Column) -> Column:
    """Image links to addresses rewritten to files named by the address's hash."""
    parts = F.split(markdown, r"!\[[^\]]*\]\(https?://[^)]*\)", -1)
    alts = F.regexp_extract_all(markdown, F.lit(r"!\[([^\]]*)\]\((https?://[^)]*)\)"), F.lit(1))
    urls = F.regexp_extract_all(markdown, F.lit(r"!\[([^\]]*)\]\((https?://[^)]*)\)"), F.lit(2))
    name = lambda u: F.concat(F.substring(F.md5(u), 1, 12), F.regexp_extract(u, r"(\.[A-Za-z0-9]{2,5})(?:[?#].*)?$", 1))
    marks = F.zip_with(alts, urls, lambda a, u: F.concat(F.lit("!["), a, F.lit("](images/"), name(u), F.lit(")")))
    return F.array_join(F.zip_with(parts, marks, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")


def source_kind(source: Column) -> Column:
    """What reads a source: by address, then by suffix."""
    low = F.lower(source)
    by_suffix = {"pdf": ("pdf",), "excel": ("xlsx", "xls"), "ppt": ("pptx",), "word": ("docx",), "image": ("png", "jpg", "jpeg", "gif", "webp"), "text": ("md", "txt")}
    out = F.when(low.rlike(r"^https?://(?:www\.)?(?:youtube\.com|youtu\.be)/"), "youtube").when(low.rlike(r"^https?://github\.com/[^/]+/[^/]+"), "github").when(low.rlike(r"^https?://"), "web")
    for kind, ends in by_suffix.items():
        out = out.when(low.rlike(rf"\.(?:{'|'.join(ends)})$"), kind)
    return out.otherwise("unsupported")


def video_id(url: Column) -> Column:
    """The 11 characters that name a video; null for other addresses."""
    found = F.regexp_extract(url, r"(?:youtu\.be/|[?&]v=|/embed/|/shorts/)([A-Za-z0-9_-]{11})(?![A-Za-z0-9_-])", 1)
    return F.when(F.length(found) > 0, found)


def transcript_sections(segments: DataFrame, seconds: int = 120) -> DataFrame:
    """(video_id, section, first, n): segments cut where one starts so many seconds after its section's first.

    A section's start depends on the one before, so a video's starts are folded in order.
    """
    starts = segments.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("start", "event_id"))).alias("s"))
    kind = "struct<ids:array<int>,id:int,start:bigint>"
    zero = F.struct(F.array().cast("array<int>").alias("ids"), F.lit(-1).alias("id"), F.lit(None).cast("long").alias("start")).cast(kind)

    def step(acc: Column, x: Column) -> Column:
        new = acc["start"].isNull() | (x["start"] - acc["start"] >= seconds)
        own = F.when(new, acc["id"] + 1).otherwise(acc["id"])
        return F.struct(F.array_append(acc["ids"], own).alias("ids"), own.alias("id"), F.when(new, x["start"]).otherwise(acc["start"]).alias("start")).cast(kind)

    each = starts.select("video_id", F.explode(F.arrays_zip(F.aggregate("s", zero, step, lambda a: a["ids"]).alias("section"), F.col("s").alias("x"))).alias("z"))
    return each.groupBy("video_id", F.col("z.section").alias("section")).agg(F.min("z.x.start").alias("first"), F.count("*").alias("n"))


def clock(seconds: Column) -> Column:
    """[mm:ss], or [hh:mm:ss] from an hour on."""
    h, m, s = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), F.floor(seconds % 60)
    return F.when(h > 0, F.format_string("[%02d:%02d:%02d]", h, m, s)).otherwise(F.format_string("[%02d:%02d]", m, s))


def sheet_blocks(rows: DataFrame, per_block: int) -> DataFrame:
    """(sheet, block, blocks, first, last, n, lines): rows (sheet, pos from 0, cells) in blocks of Markdown lines, each under its own heading."""
    clean = F.array_join(F.transform("cells", lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))), " | ")
    each = rows.select("sheet", "pos", F.floor(F.col("pos") / per_block).alias("block"), F.concat(F.lit("| "), clean, F.lit(" |")).alias("line"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    blocks = each.groupBy("sheet", "block").agg((F.min("pos") + 1).alias("first"), (F.max("pos") + 1).alias("last"), F.count("*").alias("n"), lines.alias("lines"))
    total = each.groupBy("sheet").agg(F.count("*").alias("total"))
    return blocks.join(total, "sheet").select("sheet", (F.col("block") + 1).alias("block"), F.ceil(F.col("total") / per_block).alias("blocks"), "first", "last", "n", "lines")


def font_levels(spans: DataFrame) -> DataFrame:
    """(doc, body, h1, h2, h3): the size with most characters, and the sizes from which headings begin."""
    sizes = spans.groupBy("doc", F.round("size", 1).alias("size")).agg(F.sum("n").alias("n"))
    body = sizes.groupBy("doc").agg(F.min(F.struct((-F.col("n")).alias("order"), "size")).alias("b")).select("doc", F.col("b.size").alias("body"))
    return body.select("doc", "body", *[F.round(F.col("body") * k, 3).alias(n) for n, k in (("h1", 1.5), ("h2", 1.2), ("h3", 1.1))])


def file_priority(path: Column) -> Column:
    """0 for manifests, 5 and depth for documents, 10 and depth for code, 900 for other suffixes, 999 for skipped folders."""
    low, depth = F.lower(path), F.size(F.split(path, "/")) - 1
    skipped = low.rlike(r"(?:^|/)(?:node_modules|dist|build|vendor|\.git|__pycache__)/")
    return F.when(skipped, 999).when(low.rlike(r"(?:^|/)(?:readme\.md|package\.json|pyproject\.toml|cargo\.toml|go\.mod)$"), 0).when(~low.rlike(r"\.(?:md|rst|txt|py|js|ts|go|rs|java|html)$"), 900).when(low.rlike(r"\.(?:md|rst|txt)$"), 5 + depth).otherwise(10 + depth)


def select_files(files: DataFrame, most_bytes: int = 100_000, most_files: int = 40) -> DataFrame:
    """(path, size, priority) of the files (path, size) to read, best first."""
    rows = files.withColumn("priority", file_priority(F.col("path"))).where((F.col("size") <= most_bytes) & (F.col("priority") < 900))
    return rows.orderBy("priority", "size", "path").limit(most_files).select("path", "size", "priority")


def within_budget(chosen: DataFrame, budget: int = 60_000) -> DataFrame:
    """(repo, path, n, tokens, taken) of chosen files (repo, path, n, tokens), n their order: each is taken if it still fits, the first always.

    A repository's files are at most as many as ``select_files`` chooses.
    """
    own = F.array_sort(F.collect_list(F.struct("n", "path", "tokens")))
    kind = "struct<left:bigint,taken:array<boolean>>"
    zero = F.struct(F.lit(budget).cast("long").alias("left"), F.array().cast("array<boolean>").alias("taken")).cast(kind)

    def step(acc: Column, x: Column) -> Column:
        fits = (x["tokens"] <= acc["left"]) | (F.size(acc["taken"]) == 0)
        return F.struct(F.when(fits, acc["left"] - x["tokens"]).otherwise(acc["left"]).alias("left"), F.array_append(acc["taken"], fits).alias("taken")).cast(kind)

    each = chosen.groupBy("repo").agg(own.alias("f")).select("repo", F.explode(F.arrays_zip("f", F.aggregate("f", zero, step, lambda a: a["taken"]).alias("t"))).alias("z"))
    return each.select("repo", F.col("z.f.path").alias("path"), F.col("z.f.n").alias("n"), F.col("z.f.tokens").alias("tokens"), F.col("z.t").alias("taken"))


def chosen_files(files: DataFrame, most_bytes: int = 100_000, most_files: int = 40, budget: int = 60_000) -> DataFrame:
    """(repo, path, n, tokens, taken) of the files (repo, path, size, tokens) of many repositories: the best of each, then what its budget takes."""
    rows = files.withColumn("priority", file_priority(F.col("path"))).where((F.col("size") <= most_bytes) & (F.col("priority") < 900))
    n = F.row_number().over(Window.partitionBy("repo").orderBy("priority", "size", "path"))
    return within_budget(rows.select("repo", "path", "tokens", n.alias("n")).where(F.col("n") <= most_files), budget)


def note_title(text: Column, title: Column | None = None) -> Column:
    """The given title, else the first line without its marks up to 80 characters, else note."""
    line = F.substring(F.trim(F.regexp_replace(F.split(text, "\n")[0], r"^#+", "")), 1, 80)
    own = F.when(F.length(line) > 0, line).otherwise("note")
    return own if title is None else F.coalesce(F.when(F.length(title) > 0, title), own)


def unique_names(rows: DataFrame) -> DataFrame:
    """(id, slug, name): of equal slugs the second gets _2, the third _3, in order of id."""
    n = F.row_number().over(Window.partitionBy("slug").orderBy("id"))
    return rows.select("id", "slug", n.alias("n")).select("id", "slug", F.when(F.col("n") == 1, F.col("slug")).otherwise(F.concat_ws("_", "slug", "n")).alias("name"))


def duplicates(new: DataFrame, existing: DataFrame) -> DataFrame:
    """(key, source, known): which sources (key, source) are there already, by their address."""
    return new.join(existing.select("source", F.lit(True).alias("there")).distinct(), "source", "left").select("key", "source", F.coalesce("there", F.lit(False)).alias("known"))


def slide_numbers(selector: Column) -> Column:
    """1,3,5-8 as a sorted array of numbers."""
    parts = F.filter(F.split(F.regexp_replace(selector, r"\s", ""), ","), lambda x: x.rlike(r"^[0-9]+(-[0-9]+)?$"))
    one = lambda x: F.sequence(F.least(F.split(x, "-")[0].cast("int"), F.element_at(F.split(x, "-"), -1).cast("int")), F.greatest(F.split(x, "-")[0].cast("int"), F.element_at(F.split(x, "-"), -1).cast("int")))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, one))))


def slides_without_vision(docs: DataFrame, heading: str = "시각 분석") -> DataFrame:
    """(doc_id, slide): slides of docs (doc_id, content) whose analysis is missing or empty."""
    rows = docs.select("doc_id", F.explode(F.split("content", r"(?m)(?=^## Slide [0-9]+)")).alias("s")).where(F.col("s").rlike(r"^## Slide [0-9]+"))
    analysed = F.col("s").rlike(rf"(?s)\n### {heading}[ ]*\n\s*(?!---|#)\S")
    return rows.where(~analysed).select("doc_id", F.regexp_extract("s", r"^## Slide ([0-9]+)", 1).cast("int").alias("slide"))


def note_numbers(refs: DataFrame) -> DataFrame:
    """(doc, note, number): notes (doc, pos, note) by their first place; ids up to 0 are none."""
    first = refs.where("note > 0").groupBy("doc", "note").agg(F.min("pos").alias("pos"))
    return first.select("doc", "note", F.row_number().over(Window.partitionBy("doc").orderBy("pos", "note")).alias("number"))


def tracked(runs: DataFrame) -> DataFrame:
    """(doc, text) of runs (doc, pos, kind, text): insertions as ++x++, deletions as ~~x~~."""
    mark = F.when(F.col("kind") == "insert", "++").when(F.col("kind") == "delete", "~~").otherwise("")
    return runs.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.concat(mark, "text", mark).alias("t")))), lambda x: x["t"]), "").alias("text"))
