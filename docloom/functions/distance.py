"""Edit distance of a short pattern to the nearest part of a text, by bit vectors in column functions.

The vectors are Myers' (1999), one 64-bit number each: a bit for each character of the
pattern. The text is read once, character by character, and the least distance of any part of it is kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A sum of two vectors must stay below 2**63.
MOST = 61


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """A value that is worked out once and used many times."""
    return F.transform(F.array(value), body)[0]


def nearest(text: Column, pattern: str) -> Column:
    """The least edit distance of the pattern (1 to 61 characters) to any part of the text, the empty one too; null for a null."""
    m = len(pattern)
    if not 1 <= m <= MOST:
        raise ValueError(f"a pattern has 1 to {MOST} characters")
    full, top = (1 << m) - 1, 1 << (m - 1)
    masks = {c: sum(1 << k for k, x in enumerate(pattern) if x == c) for c in pattern}
    known = F.create_map(*[F.lit(x) for c, mask in masks.items() for x in (c, mask)]).cast("map<string,bigint>")
    no = lambda x: F.bitwise_not(x).bitwiseAND(full)

    def step(acc: Column, char: Column) -> Column:
        def carried(s: Column) -> Column:
            eq = s["eq"]
            horizontal = (eq.bitwiseAND(acc["up"]) + acc["up"]).bitwiseXOR(acc["up"]).bitwiseOR(eq)
            return F.struct(horizontal.bitwiseAND(full).alias("h"), eq.bitwiseOR(acc["down"]).alias("v"))

        def moved(s: Column) -> Column:
            return F.struct(acc["down"].bitwiseOR(no(s["h"].bitwiseOR(acc["up"]))).alias("plus"), acc["up"].bitwiseAND(s["h"]).alias("minus"), s["v"].alias("v"))

        def shifted(s: Column) -> Column:
            d = acc["d"] + F.when(s["plus"].bitwiseAND(top) != 0, 1).when(s["minus"].bitwiseAND(top) != 0, -1).otherwise(0)
            return F.struct(F.shiftleft(s["plus"], 1).bitwiseAND(full).alias("plus"), F.shiftleft(s["minus"], 1).bitwiseAND(full).alias("minus"), s["v"].alias("v"), d.alias("d"))

        def closed(s: Column) -> Column:
            up = s["minus"].bitwiseOR(no(s["v"].bitwiseOR(s["plus"])))
            return F.struct(up.alias("up"), s["plus"].bitwiseAND(s["v"]).alias("down"), s["d"].cast("int").alias("d"), F.least(acc["best"], s["d"]).cast("int").alias("best"))

        eq = F.struct(F.coalesce(F.try_element_at(known, char), F.lit(0).cast("long")).alias("eq"))
        return _let(_let(_let(_let(eq, carried), moved), shifted), closed)

    zero = F.struct(F.lit(full).cast("long").alias("up"), F.lit(0).cast("long").alias("down"), F.lit(m).alias("d"), F.lit(m).alias("best"))
    return F.when(text.isNotNull(), F.aggregate(F.split(F.coalesce(text, F.lit("")), ""), zero, step)["best"])


def possible(text: Column, pattern: str, most: int) -> Column:
    """Whether a part of the text may be within ``most`` edits of the pattern: an edit spoils at most q of its q-grams, so enough of them must stand in the text."""
    for q in (3, 2, 1):
        need = len(pattern) - q + 1 - q * most
        if need > 0:
            grams = [pattern[k : k + q] for k in range(len(pattern) - q + 1)]
            found = [F.when(text.contains(g), grams.count(g)).otherwise(0) for g in dict.fromkeys(grams)]
            return sum(found[1:], found[0]) >= need
    return F.lit(True)
