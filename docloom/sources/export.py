"""Markdown to HTML, for sinks of static pages."""

from __future__ import annotations

import re
from html import escape
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ITEM = re.compile(r"([ \t]*)(?:([-*+])|[0-9]+[.)])[ \t]+(.*)")
_KINDS = (("heading", re.compile(r"#{1,6} ")), ("rule", re.compile(r"\s*(?:-{3,}|\*{3,}|_{3,})\s*$")), ("item", _ITEM), ("quote", re.compile(r">")), ("row", re.compile(r"\s*\|")), ("text", re.compile(r"\s*\S")))
#: Marks within a line, in the order in which they are taken; code spans are set aside before.
_MARKS = (
    (re.compile(r"!\[([^\]]*)\]\(([^)]*)\)"), r'<img alt="\1" src="\2">'),
    (re.compile(r"\[\[([^\]|]+)(?:\|([^\]]+))?\]\]"), lambda m: f'<a href="{m[1].replace(" ", "_")}.html">{m[2] or m[1]}</a>'),
    (re.compile(r"\[([^\]]+)\]\(([^)]*)\)"), r'<a href="\2">\1</a>'),
    (re.compile(r"\*\*(.+?)\*\*"), r"<strong>\1</strong>"),
    (re.compile(r"(?<!\*)\*([^*]+)\*(?!\*)"), r"<em>\1</em>"),
)


def _inline(text: str) -> str:
    """A line's marks; nothing within a code span is one."""
    parts = re.split(r"`([^`]+)`", escape(text.replace("\0", "")))
    line = "\0".join(parts[::2])
    for pattern, to in _MARKS:
        line = pattern.sub(to, line)
    code = iter(parts[1::2])
    return re.sub("\0", lambda _: f"<code>{next(code)}</code>", line)


def _items(lines: list[str]) -> list[str]:
    """Lists; an item that is further in than the one before it opens a list within."""
    out: list[str] = []
    open_: list[tuple[int, str]] = []
    for line in lines:
        m = _ITEM.match(line)
        depth, tag = len(m[1].expandtabs(4)), "ul" if m[2] else "ol"
        while open_ and (open_[-1][0] > depth or (open_[-1][0] == depth and open_[-1][1] != tag)):
            out[-1] += "</li>"
            out.append(f"</{open_.pop()[1]}>")
        if open_ and open_[-1][0] == depth:
            out[-1] += "</li>"
        else:
            open_.append((depth, tag))
            out.append(f"<{tag}>")
        out.append(f"<li>{_inline(m[3])}")
    for _, tag in reversed(open_):
        out[-1] += "</li>"
        out.append(f"</{tag}>")
    return out


def _rows(lines: list[str]) -> list[str]:
    """A table; what stands over a line of dashes is its head."""
    head = len(lines) > 1 and re.fullmatch(r"[|: -]*-[|: -]*", lines[1].strip()) is not None
    cells = [[_inline(c.strip()) for c in line.strip().strip("|").split("|")] for k, line in enumerate(lines) if not (head and k == 1)]
    tag = lambda k: "th" if head and k == 0 else "td"
    return ["<table>", *("<tr>" + "".join(f"<{tag(k)}>{c}</{tag(k)}>" for c in row) + "</tr>" for k, row in enumerate(cells)), "</table>"]


def _block(kind: str, lines: list[str]) -> list[str]:
    if kind == "heading":
        marks = [line.split(" ", 1) for line in lines]
        return [f"<h{len(m)}>{_inline(title.strip())}</h{len(m)}>" for m, title in marks]
    if kind == "rule":
        return ["<hr>"] * len(lines)
    if kind == "quote":
        return ["<blockquote>", *(_inline(line.lstrip("> ")) for line in lines), "</blockquote>"]
    return {"item": _items, "row": _rows, "text": lambda x: [f"<p>{_inline(line.strip())}</p>" for line in x]}.get(kind, lambda x: [])(lines)


def markdown_to_html(text: str | None) -> str:
    """Headings, rules, quotes, nested lists, tables with heads, fences and paragraphs of a text without its front matter."""
    body = re.sub(r"(?s)\A---\n.*?\n---\n", "", text or "")
    out: list[str] = []
    kind_of = lambda line: next((k for k, pattern in _KINDS if pattern.match(line)), "blank")
    # odd parts are what stands between fences; the last fence may stay open
    for k, part in enumerate(re.split(r"(?m)^```.*\n?", body)):
        if k % 2:
            out += ["<pre>", escape(part.rstrip("\n")), "</pre>"]
        else:
            for kind, lines in groupby(part.split("\n"), kind_of):
                out += _block(kind, list(lines))
    return "\n".join(out)


@F.pandas_udf(T.StringType())
def _html(text: pd.Series) -> pd.Series:
    return text.map(markdown_to_html)


def html_pages(pages: DataFrame) -> DataFrame:
    """(slug, html) of pages (slug, content)."""
    return pages.select("slug", _html("content").alias("html"))
