"""Rows of office files, code repositories and transcripts as Markdown. Parsers give the rows; these plans write the pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.sources.ingest import clock

#: The fence's language of a suffix.
LANGUAGES = {
    "py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "go": "go", "rs": "rust", "java": "java", "kt": "kotlin", "swift": "swift", "cpp": "cpp", "c": "c", "h": "c",
    "cs": "csharp", "rb": "ruby", "toml": "toml", "json": "json", "yaml": "yaml", "yml": "yaml", "md": "markdown", "rst": "rst", "sh": "bash", "dockerfile": "dockerfile",
}


def joined(rows: DataFrame, keys: list[str], order: list[str], text: Column, by: str, name: str = "markdown") -> DataFrame:
    """(keys..., name): the texts of a group in order; nulls are left out."""
    listed = F.array_sort(F.collect_list(F.when(text.isNotNull(), F.struct(*order, text.alias("_x")))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda x: x["_x"]), by).alias(name))


def cell(value: Column, formula: Column | None = None) -> Column:
    """A cell's text in a table: integral floats without .0, bars escaped, lines joined, a formula behind its value."""
    shown = F.coalesce(value, F.lit(""))
    shown = F.when(shown.rlike(r"^-?[0-9]+\.0$"), F.regexp_replace(shown, r"\.0$", "")).otherwise(shown)
    shown = F.replace(F.replace(F.replace(shown, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(""))
    if formula is None:
        return shown
    code = F.concat(F.lit("`[formula: "), F.replace(formula, F.lit("|"), F.lit("\\|")), F.lit("]`"))
    return F.when(formula.startswith("="), F.concat(shown, F.when(shown != "", " ").otherwise(""), code)).otherwise(shown)


def table_line(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def sheet_pages(cells: DataFrame, per_block: int) -> DataFrame:
    """(sheet, block, markdown) of cells (sheet, row, col, value, formula): row 0 heads every block of ``per_block`` rows; a blank head is named by its column.

    A sheet without row 0 has blank heads, and one with row 0 only is a block of its head. Of several values in one
    cell the greatest text counts; a cell without row or column is left out. Rows come from cells,
    blocks from rows; a block is as large as ``per_block`` rows.
    """
    cells = cells.where("row IS NOT NULL AND col IS NOT NULL")
    width = cells.groupBy("sheet").agg(F.max("col").alias("width"), F.max("row").alias("total"))
    listed = cells.select("sheet", "row", F.struct("col", cell(F.col("value"), F.col("formula")).alias("x")).alias("c")).groupBy("sheet", "row").agg(F.array_sort(F.collect_list("c")).alias("c"))
    last = F.filter("c", lambda x, k: F.coalesce(F.get("c", k + 1)["col"] != x["col"], F.lit(True)))
    same = width["sheet"].eqNullSafe(F.col("_sheet"))
    lines = listed.select(F.col("sheet").alias("_sheet"), "row", F.map_from_entries(last).alias("m")).join(width, same).drop("_sheet")
    own = F.transform(F.sequence(F.lit(0), F.col("width")), lambda k: F.coalesce(F.try_element_at("m", k), F.lit("")))
    named = lambda x, k: F.when(x == "", F.concat(F.lit("열"), k + 1)).otherwise(x)
    every = F.sequence(F.lit(0), F.col("width"))
    rule = table_line(F.transform(every, lambda k: F.lit("---")))
    first = lines.where("row = 0").select(F.col("sheet").alias("_sheet"), table_line(F.transform(own, named)).alias("head"))
    head = width.join(first, same, "left").select("sheet", "total", F.concat_ws("\n", F.coalesce("head", table_line(F.transform(every, lambda k: F.concat(F.lit("열"), k + 1)))), rule).alias("head"))
    rows = lines.where("row > 0").select(F.col("sheet").alias("_sheet"), F.floor((F.col("row") - 1) / per_block).alias("block"), "row", table_line(own).alias("line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), "\n")
    blocks = rows.groupBy("_sheet", "block").agg(F.min("row").alias("first"), F.max("row").alias("last"), text.alias("lines"))
    blocks = head.join(blocks, head["sheet"].eqNullSafe(blocks["_sheet"]), "left")
    n = F.ceil(F.col("total") / per_block)
    title = F.when(n > 1, F.format_string("**행 %d–%d / 전체 %d행 (청크 %d/%d)**\n\n", "first", "last", "total", F.col("block") + 1, n)).otherwise("")
    return blocks.select("sheet", (F.coalesce("block", F.lit(0)) + 1).alias("block"), F.concat(F.when(F.col("block").isNull(), "").otherwise(title), "head", F.coalesce(F.concat(F.lit("\n"), "lines"), F.lit(""))).alias("markdown"))


def chart_texts(charts: DataFrame) -> DataFrame:
    """(sheet, chart, markdown) of charts (sheet, chart, kind, title, series): kind, title and the names of the series."""
    title = F.when(F.coalesce(F.col("title"), F.lit("")) != "", F.concat(F.lit(" / 제목: "), "title")).otherwise("")
    head = F.concat(F.lit("**[차트 "), F.col("chart").cast("string"), F.lit("]** 유형: "), "kind", title)
    series = F.transform("series", lambda x, k: F.concat(F.lit("  - 시리즈 "), (k + 1).cast("string"), F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(": "), x)).otherwise("")))
    return charts.select("sheet", "chart", F.array_join(F.concat(F.array(head), series), "\n").alias("markdown"))


def slide_line(text: Column, level: Column, size: Column) -> Column:
    """A slide's paragraph: large ones are headings, lower levels list items; null if blank."""
    own = F.trim(text)
    line = F.when(size >= 28, F.concat(F.lit("### "), own)).when(size >= 20, F.concat(F.lit("#### "), own)).when(level == 0, own).otherwise(F.concat(F.repeat(F.lit("  "), level.cast("int")), F.lit("- "), own))
    return F.when(own != "", line)


def slide_pages(paragraphs: DataFrame, notes: DataFrame) -> DataFrame:
    """(deck, slide, markdown) of paragraphs (deck, slide, shape, pos, text, level, size), whose shape 0 is the title, and notes (deck, slide, note)."""
    title = paragraphs.where("shape = 0").groupBy("deck", "slide").agg(F.min(F.struct("pos", F.trim("text").alias("t")))["t"].alias("title"))
    line = slide_line(F.col("text"), F.col("level"), F.col("size"))
    shapes = joined(paragraphs.where("shape > 0"), ["deck", "slide", "shape"], ["pos"], line, "\n", "body").where("body <> ''")
    bodies = joined(shapes, ["deck", "slide"], ["shape"], F.col("body"), "\n\n", "body")
    own = paragraphs.select("deck", "slide").distinct().join(title, ["deck", "slide"], "left").join(bodies, ["deck", "slide"], "left").join(notes.where("trim(note) <> ''"), ["deck", "slide"], "left")
    head = F.concat(F.format_string("## Slide %d", "slide"), F.when(F.coalesce("title", F.lit("")) != "", F.concat(F.lit(": "), "title")).otherwise(""))
    note = F.concat(F.lit("\n> **Note:**\n> "), F.replace(F.trim("note"), F.lit("\n"), F.lit("\n> ")))
    return own.select("deck", "slide", F.concat_ws("\n\n", head, "body", note).alias("markdown"))


def paragraph_line(style: Column, text: Column) -> Column:
    """A paragraph of a document by its style: headings 1 to 6, list items, plain text; null if blank."""
    own, name = F.trim(text), F.lower(style)
    level = F.regexp_extract(name, r"^heading ([1-6])$", 1)
    line = F.when(level != "", F.concat(F.repeat(F.lit("#"), F.coalesce(level.try_cast("int"), F.lit(0))), F.lit(" "), own)).when(name.contains("bullet"), F.concat(F.lit("- "), own))
    line = line.when(name.contains("list number") | name.contains("list paragraph"), F.concat(F.lit("1. "), own)).otherwise(own)
    return F.when(own != "", line)


def document_pages(blocks: DataFrame) -> DataFrame:
    """(doc, markdown) of blocks (doc, pos, style, text, cells) in order: paragraphs, and runs of table rows (cells isn't null) with a rule below the first.

    A table's rows follow each other; its first row is the one that no table row stands right before.
    """
    line = F.when(F.col("cells").isNotNull(), table_line(F.transform("cells", lambda x: F.replace(F.replace(F.trim(x), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))))).otherwise(paragraph_line(F.col("style"), F.col("text")))
    own = blocks.select("doc", F.struct("pos", line.alias("x"), F.col("cells").isNotNull().alias("row"), F.size("cells").alias("n")).alias("b"))
    lists = own.groupBy("doc").agg(F.array_sort(F.collect_list("b")).alias("b"))
    kept = F.filter("b", lambda x: x["x"].isNotNull())
    lists = lists.select("doc", kept.alias("b"))

    def piece(x: Column, k: Column) -> Column:
        inside = (k > 0) & x["row"] & F.coalesce(F.get("b", k - 1)["row"], F.lit(False))
        gap = F.when(k == 0, "").when(inside, "\n").otherwise("\n\n")
        rule = F.when(x["row"] & ~inside, F.concat(F.lit("\n| "), F.array_join(F.array_repeat(F.lit("---"), x["n"]), " | "), F.lit(" |"))).otherwise("")
        return F.concat(gap, x["x"], rule)

    return lists.select("doc", F.array_join(F.transform("b", piece), "").alias("markdown"))


def pdf_pages(lines: DataFrame, levels: DataFrame) -> DataFrame:
    """(doc, page, markdown) of lines (doc, page, block, pos, text, size, bold): headings by the document's font levels (doc, h1, h2, h3), short bold lines emphasised."""
    own, size = F.trim("text"), F.col("size")
    level = F.when(size >= F.col("h1"), 1).when(size >= F.col("h2"), 2).when(size >= F.col("h3"), 3).otherwise(0)
    line = F.when(level > 0, F.concat(F.repeat(F.lit("#"), level), F.lit(" "), own)).when(F.col("bold") & (F.length(own) < 120), F.concat(F.lit("**"), own, F.lit("**"))).otherwise(own)
    rows = lines.join(levels.select("doc", "h1", "h2", "h3"), "doc").where(own != "").select("doc", "page", "block", "pos", line.alias("line"))
    blocks = joined(rows, ["doc", "page", "block"], ["pos"], F.col("line"), "\n", "text")
    return joined(blocks, ["doc", "page"], ["block"], F.col("text"), "\n\n")


def repository_pages(repos: DataFrame, files: DataFrame, skipped: DataFrame) -> DataFrame:
    """(repo, markdown) of repositories (repo, description, language, stars, license, branch), files that were read (repo, pos, path, content) and names that weren't (repo, path).

    Files are chosen under a budget before, so a page is as large as that budget.
    """
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    language = F.coalesce(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[suffix], F.lit(""))
    text = F.rtrim(F.col("content"), F.lit(" \n\t\r"))
    shown = F.when(language.isin("markdown", "rst"), text).otherwise(F.concat(F.lit("```"), language, F.lit("\n"), text, F.lit("\n```")))
    one = files.select("repo", "pos", F.concat(F.lit("- `"), "path", F.lit("`")).alias("name"), F.concat(F.lit("## `"), "path", F.lit("`\n\n"), shown, F.lit("\n")).alias("part"))
    lists = joined(one, ["repo"], ["pos"], F.col("name"), "\n", "names").join(joined(one, ["repo"], ["pos"], F.col("part"), "\n", "parts"), "repo")
    five = F.slice(F.array_sort(F.collect_list(F.concat(F.lit("`"), "path", F.lit("`")))), 1, 5)
    left = skipped.groupBy("repo").agg(F.count("*").alias("n"), F.array_join(five, ", ").alias("some"))
    facts = F.concat_ws(" · ", F.concat(F.lit("**언어:** "), "language"), F.when(F.col("stars") > 0, F.concat(F.lit("**Stars:** "), F.format_number("stars", 0))), F.concat(F.lit("**라이선스:** "), "license"))
    note = F.coalesce(F.concat(F.lit("\n\n> 토큰 예산 초과로 "), F.col("n").cast("string"), F.lit("개 파일 생략: "), "some", F.when(F.col("n") > 5, "...").otherwise("")), F.lit(""))
    head = [F.concat(F.lit("# "), "repo", F.lit("\n\n")), F.coalesce(F.concat(F.lit("> "), "description", F.lit("\n\n")), F.lit("")), F.when(facts != "", F.concat(facts, F.lit("\n\n"))).otherwise("")]
    where = [F.lit("**레포:** https://github.com/"), F.col("repo"), F.lit("\n**브랜치:** `"), F.col("branch"), F.lit("`\n\n---\n\n## 수집 파일 목록\n\n"), F.col("names"), note, F.lit("\n\n---\n\n"), F.col("parts")]
    return repos.join(lists, "repo").join(left, "repo", "left").select("repo", F.concat(*head, *where).alias("markdown"))


def transcript_pages(sections: DataFrame) -> DataFrame:
    """(video_id, section, markdown) of segments with their section (video_id, section, first, pos, text): a heading with the time and its link, then the text."""
    text = F.trim(F.replace("text", F.lit("\n"), F.lit(" ")))
    rows = joined(sections.where(text != ""), ["video_id", "section", "first"], ["pos"], text, " ", "text")
    at = F.floor("first").cast("long").cast("string")
    return rows.select("video_id", "section", F.concat(F.lit("## "), clock(F.col("first")), F.lit("(https://www.youtube.com/watch?v="), F.col("video_id").cast("string"), F.lit("&t="), at, F.lit("s)\n\n"), "text").alias("markdown"))


def uploads(names: DataFrame, files: DataFrame) -> DataFrame:
    """(name, duplicate): uploads (name) whose slug is a file's stem (stem), or its beginning before an underscore."""
    slug = F.regexp_replace(F.regexp_replace(F.lower("name"), r"[^\p{L}\p{N}_\-]+", "-"), r"^-+|-+$", "")
    stems = [files.select("stem"), files.select(F.explode(F.filter(F.transform(F.sequence(F.lit(1), F.length("stem")), lambda k: F.when(F.substring(F.col("stem"), k, F.lit(1)) == "_", F.substring(F.col("stem"), F.lit(1), k - 1))), lambda x: x.isNotNull())).alias("stem"))]
    known = reduce(DataFrame.union, stems).distinct()
    return names.select("name", slug.alias("stem")).join(known.withColumn("there", F.lit(True)), "stem", "left").select("name", F.coalesce("there", F.lit(False)).alias("duplicate"))


def concept_text(profile: DataFrame) -> DataFrame:
    """(name, text): a node's neighbours (name, parents, children, enables, requires, contradicts) as lines for a reader; empty kinds are left out."""
    label = {"parents": "상위 개념", "children": "하위 개념", "enables": "가능하게 함", "requires": "필요로 함", "contradicts": "상충"}
    lines = [F.when(F.col(k) != "", F.concat(F.lit(f"- {v}: "), F.replace(k, F.lit(","), F.lit(", ")))) for k, v in label.items()]
    return profile.select("name", F.concat_ws("\n", F.concat(F.lit("# "), "name"), *lines).alias("text"))
