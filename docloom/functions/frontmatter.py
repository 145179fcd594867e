"""Front matter, read as the subset of YAML that pages use, by column functions.

A key stands at the beginning of a line, plain or in quotes, and its value is what
follows up to the next key: a scalar (plain, in single or double quotes, over several lines),
a block scalar (``|`` or ``>``, with ``-`` or ``+``), a flow list (``[a, "b, c"]``) or a block
list (lines of ``- item``). Of repeated keys the last counts. Comments are left out.
Anchors, tags, flow maps and lists of lists are kept as they are written.
A text without front matter has an empty map.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.text import front_matter, once

_KEY = r"""[^\s#:\-"'\[{][^:\n]*|"[^"\n]*"|'[^'\n]*'"""
_ENTRY = rf"(?m)^({_KEY}):(?=[ \t\n]|\z)([^\n]*(?:\n(?:[ \t]+[^\n]*|-[ ][^\n]*|-(?=\n|\z)|(?=\n[ \t]))?)*)"
_ITEM = r"(?m)^[ ]*-(?:[ ]+|(?=\n|\z))([^\n]*(?:\n[ ]+(?![ ]*-(?:[ ]|\n|\z))[^\n]*)*)"
_FLOW = r""""(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^,\s][^,]*"""
_BLANK = " \t\r\n"


def raw_values(text: Column) -> Column:
    """The front matter as a map from keys to their values as they are written."""

    def entries(own: Column) -> Column:
        keys = F.transform(F.regexp_extract_all(own, F.lit(_ENTRY), F.lit(1)), lambda k: F.regexp_replace(F.trim(k), r"""^(["'])(.*)\1$""", "$2"))
        values = F.transform(F.regexp_extract_all(own, F.lit(_ENTRY), F.lit(2)), lambda v: F.when(F.trim(v, F.lit(_BLANK)).rlike(r"^[|>]"), v).otherwise(F.rtrim(v, F.lit(_BLANK))))
        return F.transform(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda e: F.struct(e["k"].alias("key"), F.ltrim(e["v"], F.lit(" \t")).alias("value")))

    return last_of(once(F.coalesce(front_matter(text), F.lit("")), entries))


def last_of(entries: Column) -> Column:
    """A map of entries (key, value) in which the last of equal keys counts."""
    return F.map_from_entries(once(entries, lambda own: F.filter(own, lambda e, i: ~F.exists(F.slice(own, i + 2, F.size(own)), lambda later: later["key"] == e["key"]))))


def _unquoted(x: Column) -> Column:
    """A scalar of one line or of folded lines, without its quotes or comment; null for a null."""
    double, single = F.regexp_extract(x, r'(?s)^("(?:[^"\\]|\\.)*")', 1), F.regexp_extract(x, r"(?s)^'((?:[^']|'')*)'", 1)
    plain = F.rtrim(F.regexp_replace(x, r"(?m)(?:^|[ \t]+)#.*$", ""), F.lit(_BLANK))
    told = F.coalesce(F.from_json(F.concat(F.lit("["), double, F.lit("]")), "array<string>")[0], F.regexp_extract(x, r'(?s)^"(.*?)"[ \t]*$', 1))
    return F.when(x.startswith('"'), told).when(x.startswith("'"), F.replace(single, F.lit("''"), F.lit("'"))).when(plain.isin("", "~", "null", "Null", "NULL"), F.lit(None).cast("string")).otherwise(plain)


def _folded(x: Column) -> Column:
    """Lines of a scalar joined: a break is a space, blank lines are breaks."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"[ \t]*\n[ \t]*\n[ \t]*", "\u0001"), r"[ \t]*\n[ \t]*", " "), "\u0001", "\n")


def _block_scalar(x: Column) -> Column:
    head, rest = F.regexp_extract(x, r"^([|>][-+0-9]*)", 1), F.regexp_extract(x, r"(?s)^[|>][^\n]*\n(.*)$", 1)
    indent = F.length(F.regexp_extract(rest, r"^(?:[ ]*\n)*([ ]*)", 1))
    lines = F.transform(F.split(rest, "\n"), lambda line: F.substr(line, indent + 1))
    text = F.array_join(lines, "\n")
    body = F.rtrim(text, F.lit("\n "))
    folded = F.regexp_replace(F.regexp_replace(F.regexp_replace(body, r"\n\n", "\u0001"), r"\n", " "), "\u0001", "\n")
    end = F.when(head.contains("-"), "").when(body == "", "").otherwise("\n")
    return F.concat(F.when(head.startswith(">"), folded).otherwise(body), end)


def scalar(value: Column) -> Column:
    """A written value as a text; null if it is null or empty; a list as it is written."""
    x = F.trim(value, F.lit(_BLANK))
    return F.when(x.rlike(r"^[|>][-+0-9]*[ ]*(?:\n|\z)"), _block_scalar(F.ltrim(value, F.lit(_BLANK)))).otherwise(_unquoted(_folded(x)))


def items(value: Column) -> Column:
    """A written value as an array: a list's items, or one scalar; empty for a null."""
    x = F.trim(value, F.lit(_BLANK))
    flow = F.transform(F.regexp_extract_all(F.regexp_extract(x, r"(?s)^\[(.*)\]", 1), F.lit(_FLOW), F.lit(0)), lambda v: _unquoted(F.rtrim(_folded(v), F.lit(_BLANK))))
    block = F.transform(F.regexp_extract_all(x, F.lit(_ITEM), F.lit(1)), lambda v: F.when(v.rlike(r"^[\w-]+:[ \n]"), F.trim(v)).otherwise(_unquoted(_folded(F.trim(v, F.lit(_BLANK))))))
    one = scalar(value)
    return F.when(x.rlike(r"^\["), flow).when(x.rlike(r"^-(?:[ \n]|\z)"), block).when(one.isNull(), F.array().cast("array<string>")).otherwise(F.array(one))


#: What a plain scalar is, by the core rules of YAML 1.1.
KINDS = {
    "bool": r"^(?:yes|Yes|YES|no|No|NO|true|True|TRUE|false|False|FALSE|on|On|ON|off|Off|OFF)$",
    "int": r"^[-+]?(?:0|[1-9][0-9_]*)$",
    "float": r"^[-+]?(?:[0-9][0-9_]*)\.[0-9_]*(?:[eE][-+][0-9]+)?$",
    "date": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$",
}


def typed(text: Column) -> Column:
    """The front matter as a map from keys to (kind, text, items); kind is list, null, string, bool, int, float or date."""

    def value(_: Column, v: Column) -> Column:
        x = F.trim(v, F.lit(_BLANK))
        own = scalar(v)
        kind = F.when(x.rlike(r"^(?:\[|-(?:[ \n]|\z))"), "list").when(own.isNull(), "null").when(x.rlike(r"""^["'|>]"""), "string")
        for name, pattern in KINDS.items():
            kind = kind.when(own.rlike(pattern), name)
        return F.struct(kind.otherwise("string").alias("kind"), F.when(x.rlike(r"^(?:\[|-(?:[ \n]|\z))"), F.lit(None).cast("string")).otherwise(own).alias("text"), items(v).alias("items"))

    return F.transform_values(raw_values(text), value)


def quoted(value: Column) -> Column:
    """A text as a scalar that reads back as the same text."""
    special = value.rlike(r"""^[\s\-?:,\[\]{}#&*!|>'"%@`]|:[ ]|:$|[ ]#|\n|[ ]$""") | (value == "") | value.isin("~", "null", "Null", "NULL")
    for pattern in KINDS.values():
        special = special | value.rlike(pattern)
    inner = F.replace(F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    return F.when(special, F.concat(F.lit('"'), inner, F.lit('"'))).otherwise(value)
