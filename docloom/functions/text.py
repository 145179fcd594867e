"""Column functions: token budgets, front matter, Markdown, slugs and templates.

All are built-in expressions. A null text gives null, but for token estimates,
where it is empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.settings import Settings

#: A run of letters, digits and underscores in any script, two or more.
WORD = r"[\p{L}\p{N}_]{2,}"


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """A function of a value that is computed once, however often the function names it."""
    return F.transform(F.array(value), then)[0]


def estimate_tokens(text: Column) -> Column:
    """A quarter of the UTF-8 bytes, rounded up, at least 1."""
    return F.greatest(F.lit(1), F.ceil(F.coalesce(F.octet_length(text), F.lit(0)) / 4)).cast("long")


def strategy(tokens: Column, s: Settings) -> Column:
    """single_pass, map_reduce or hierarchical; both bounds belong to the lower side."""
    return F.when(tokens <= s.single_pass * s.available, "single_pass").when(tokens <= s.map_reduce * s.available, "map_reduce").otherwise("hierarchical")


def chunks_needed(tokens: Column, s: Settings) -> Column:
    """1 for a single pass, else the tokens by the room of a chunk, rounded up."""
    room = max(s.available - s.overlap, s.min_chunk)
    return F.when(strategy(tokens, s) == "single_pass", 1).otherwise(F.ceil(tokens / room)).cast("long")


def front_matter(text: Column) -> Column:
    """The lines between the leading marks; null without them."""
    end = F.locate("\n---", text, 4)
    return F.when(text.startswith("---") & (end > 0), F.substring(text, F.lit(4), end - 4))


def field(text: Column, name: str) -> Column:
    """A scalar of the front matter; null if it isn't there."""
    found = F.trim(F.regexp_extract(front_matter(text), rf"(?m)^{name}:[ ]*(.*)$", 1))
    return F.when(F.length(found) > 0, found)


def body(text: Column) -> Column:
    """The text after the front matter, trimmed; the text itself without front matter."""
    end = F.locate("\n---", text, 4)
    rest = F.rtrim(F.ltrim(F.substr(text, end + 4), F.lit(" \n\t\r\v\f")), F.lit(" \n\t\r"))
    return F.when(text.startswith("---") & (end > 0), rest).otherwise(text)


def first_h1(text: Column) -> Column:
    """The first top heading; null without one."""
    found = F.trim(F.regexp_extract(text, r"(?m)^#[ \t]+(.+)$", 1))
    return F.when(F.length(found) > 0, found)


def title(text: Column, stem: Column) -> Column:
    """Front matter's title, else the first top heading, else the stem with spaces."""
    return F.coalesce(field(text, "title"), first_h1(text), F.replace(stem, F.lit("_"), F.lit(" ")))


def plain(text: Column) -> Column:
    """Text without code, heading marks, link targets and emphasis, with single spaces."""
    for pattern, to in ((r"(?s)```.*?```", " "), (r"`[^`]*`", " "), (r"(?m)^#{1,6}[ ]+", ""), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"[*_~|>]", " "), (r"[\s\p{Z}]+", " ")):
        text = F.regexp_replace(text, pattern, to)
    return F.trim(text)


def excerpt(text: Column, size: int = 300) -> Column:
    """The first characters of the plain body."""
    return F.substring(plain(body(text)), 1, size)


def section(text: Column, heading: str) -> Column:
    """What stands below a second-level heading, up to the next; null without it."""
    found = F.regexp_extract(text, rf"(?s)(?:^|\n)##[ ]*{heading}[ ]*\n(.*?)(?=\n##[ ]|\z)", 1)
    return F.when(text.rlike(rf"(?s)(?:^|\n)##[ ]*{heading}[ ]*\n"), F.trim(found, F.lit(" \n\t\r")))


def summary(text: Column, heading: str = "핵심 요약", size: int = 300) -> Column:
    """The summary section, else the first paragraph that is no heading."""
    paragraphs = F.filter(F.split(body(text), r"\n{2,}"), lambda x: (F.length(F.trim(x)) > 0) & ~F.trim(x).startswith("#"))
    return F.substring(F.coalesce(section(text, heading), F.try_element_at(paragraphs, F.lit(1))), 1, size)


def first_paragraph(text: Column) -> Column:
    """The body's first block, with the second if the first is a heading."""
    blocks = F.split(body(text), r"\n{2,}")
    return F.when(blocks[0].startswith("#"), F.array_join(F.slice(blocks, 1, 2), "\n\n")).otherwise(blocks[0])


def list_items(text: Column, heading: str) -> Column:
    """Items of a named section's list, links as their names; items in brackets only are placeholders."""
    lines = F.split(section(text, heading), "\n")
    items = F.transform(F.filter(lines, lambda x: x.rlike(r"^[ ]*(?:[-*]|[0-9]+[.)])[ ]+.+")), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"^[ ]*(?:[-*]|[0-9]+[.)])[ ]+", ""), r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]", "$1")))
    return F.filter(items, lambda x: ~x.rlike(r"^\(.*\)$"))


def strip_fence(text: Column) -> Column:
    """What a fenced block holds, else the trimmed text."""
    fenced = F.regexp_extract(text, r"(?s)```(?:markdown|json|md)?[ ]*\n(.*?)\n?```", 1)
    return F.when(text.rlike(r"(?s)```(?:markdown|json|md)?[ ]*\n.*?```"), F.trim(fenced, F.lit(" \n\t\r"))).otherwise(F.trim(text, F.lit(" \n\t\r")))


def slug(text: Column, size: int = 60) -> Column:
    """Lower-cased letters, digits and hyphens, cut to a length; text is taken as composed already."""
    out = F.lower(F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}_ \-]", ""), r"[ _]+", "-"))
    return F.regexp_replace(F.substring(F.regexp_replace(F.regexp_replace(out, r"-+", "-"), r"^-|-$", ""), 1, size), r"-$", "")


def file_stem(name: Column) -> Column:
    """A name with runs of other characters as one underscore."""
    return F.regexp_replace(F.regexp_replace(name, r"[^\p{L}\p{N}_]+", "_"), r"^_+|_+$", "")


def render(template: str, values: dict[str, Column]) -> Column:
    """A template with its variables filled in; unknown ones stay."""
    out = F.lit(template)
    for name, value in values.items():
        for mark in ("{{ " + name + " }}", "{{" + name + "}}"):
            out = F.replace(out, F.lit(mark), value)
    return out


def json_array(text: Column) -> Column:
    """The JSON array in a model's answer: of a fenced block, else from the first to the last bracket."""
    return F.regexp_extract(strip_fence(text), r"(?s)\[.*\]", 0)


def question_words(question: str) -> list[str]:
    """The words of a question with repeats."""
    import re

    return re.findall(r"\w{2,}", question.lower())


def relevance(words: list[str], text: Column, stem: Column) -> Column:
    """2 for each word in the stem and 1 in the text, over the number of words."""
    if not words:
        return F.lit(0.0)
    low, name = F.lower(F.coalesce(text, F.lit(""))), F.replace(F.lower(F.coalesce(stem, F.lit(""))), F.lit("_"), F.lit(" "))
    hits = [F.when(name.contains(w), n * 2).otherwise(0) + F.when(low.contains(w), n).otherwise(0) for w, n in sorted({w: words.count(w) for w in words}.items())]
    total = hits[0]
    for h in hits[1:]:
        total = total + h
    return total / F.lit(float(len(words)))


def byte_tail(text: Column, size: int) -> Column:
    """The last bytes of a text, without a broken first character."""
    tail = F.substring(text.cast("binary"), -size, size).cast("string")
    return F.when(F.octet_length(text) <= size, text).otherwise(F.ltrim(F.make_valid_utf8(tail), F.lit("�")))


def byte_head(text: Column, size: int) -> Column:
    """The first bytes of a text, without a broken last character."""
    head = F.substring(text.cast("binary"), 1, size).cast("string")
    return F.when(F.octet_length(text) <= size, text).otherwise(F.rtrim(F.make_valid_utf8(head), F.lit("\ufffd")))


def with_date(text: Column, date: Column) -> Column:
    """The front matter with last_updated set; a text without front matter stays."""
    line = F.concat(F.lit("last_updated: "), date)
    replaced = F.concat(F.regexp_extract(text, r"(?s)^(---.*?\n)last_updated:[^\n]*", 1), line, F.regexp_extract(text, r"(?s)^---.*?\nlast_updated:[^\n]*(.*)$", 1))
    added = F.concat(F.regexp_extract(text, r"(?s)^(---.*?\n)---", 1), line, F.lit("\n"), F.regexp_extract(text, r"(?s)^---.*?\n(---.*)$", 1))
    own = front_matter(text)
    return F.when(own.isNull(), text).when(own.rlike(r"(?m)^last_updated:"), replaced).otherwise(added)


def kept_merge(merged: Column, original: Column) -> Column:
    """A model's merged page, unless it is short or has no heading; then the original."""
    return F.when((F.length(merged) < 50) | ~merged.contains("#") | merged.isNull(), original).otherwise(merged)
