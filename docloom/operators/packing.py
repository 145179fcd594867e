"""Next-fit packing of long sequences: jumps over prefix sums, followed by pointer doubling.

A bin takes items in order until the next doesn't fit; an item marked as alone has a bin
of its own. Where a bin that begins at an item would end is a jump, which prefix sums tell by one sort. The bins'
beginnings are what the jumps reach from the first item: after k rounds of joining the jumps with themselves,
those within 2**k jumps are known, each with its number. So a sequence of any length
is rows throughout, never one cell, and rounds grow with the logarithm of its bins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.session import materialize


def jumps(items: DataFrame, most: int) -> DataFrame:
    """(key, n, to) of items (key, n from 0, tokens, alone): where the bin after one that begins at n begins; null at the end."""
    own = Window.partitionBy("key")
    before, after = own.orderBy("n").rowsBetween(Window.unboundedPreceding, 0), own.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    rows = items.select("key", "n", "tokens", "alone", F.sum("tokens").over(before).alias("upto"), F.last(F.when(F.col("alone"), F.col("n")), True).over(after).alias("lone"))
    # the first item whose sum is above what a bin from here may reach: sums and limits in one descending order, limits first among equals
    sums = rows.select("key", F.col("upto").alias("v"), F.lit(1).alias("kind"), "n", "lone", "alone")
    limits = rows.select("key", (F.col("upto") - F.col("tokens") + most).alias("v"), F.lit(0).alias("kind"), "n", "lone", "alone")
    down = own.orderBy(F.desc("v"), "kind", "n").rowsBetween(Window.unboundedPreceding, 0)
    over = sums.union(limits).withColumn("over", F.last(F.when(F.col("kind") == 1, F.col("n")), True).over(down)).where("kind = 0")
    # an item above the limit by itself is taken by the bin that it begins
    to = F.when(F.col("alone"), F.col("n") + 1).otherwise(F.least(F.when(F.col("over").isNotNull(), F.greatest("over", F.col("n") + 1)), "lone"))
    last = items.groupBy("key").agg(F.max("n").alias("last"))
    return over.select("key", "n", to.alias("to")).join(last, "key").select("key", "n", F.when(F.col("to") <= F.col("last"), F.col("to")).alias("to"))


def starts(links: DataFrame) -> DataFrame:
    """(key, n, bin): what jumps (key, n, to) reach from n = 0, with the number of jumps."""
    reached = links.where("n = 0").select("key", "n", F.lit(0).cast("long").alias("bin"))
    links = materialize(links.where("to IS NOT NULL"), "jumps")
    k = 0
    while links.limit(1).count():
        further = reached.join(links, ["key", "n"]).select("key", F.col("to").alias("n"), (F.col("bin") + (1 << k)).alias("bin"))
        reached = materialize(reached.union(further), "reached")
        again = links.select("key", F.col("n").alias("to"), F.col("to").alias("_to"))
        links = materialize(links.join(again, ["key", "to"]).select("key", "n", F.col("_to").alias("to")), "jumps")
        k += 1
    return reached


def next_fit(items: DataFrame, most: int) -> DataFrame:
    """(key, n, bin): the bin from 0 of each item (key, n from 0 without gaps, tokens of at least 1, alone)."""
    items = materialize(items.select("key", "n", "tokens", "alone"), "items")
    firsts = starts(materialize(jumps(items, most), "links"))
    seen = Window.partitionBy("key").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return items.join(firsts, ["key", "n"], "left").select("key", "n", F.last("bin", True).over(seen).alias("bin"))
