"""Mixing sources to target weights.

Every document gets a hash-random key, of its id and its text; within a source,
documents stand in the order of their keys. The keys' leading digits cut that
order into ranges. Sums per source and range, and prefix sums over the ranges,
say in which range a source's budget ends; that range is cut into ranges again,
and in the last one keys are summed, which finds the key at the cut. Whole epochs
come first, the rest is cut exactly.

Only exact repeats, of id and text, have the same key. Those at a cut stand in
the order of stored row numbers, by prefix sums over the parts that hold them.

Sources stand by code point with null last and carry the given weights in turn.
Their targets share ``percent`` % of all sizes by weight; a target stops at
``most`` times its source's size and the excess goes to the others by weight,
until none is above (the level is found in closed form, over one row per source).

Nulls and empties: a null source is a source of its own; a null or empty text has
size 0 and takes no words; a null doc_id is an id of its own. Each of repeated
rows is a document. Further columns are ignored, or kept by ``mix``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import materialize, small_or_none


@dataclass(frozen=True)
class Mix:
    """Parameters; ``digits`` hexadecimal digits of the key make a range."""

    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    percent: int = 150
    most: int = 2
    seed: int = 17
    digits: int = 3
    #: Up to so many sources are broadcast to the documents.
    broadcast_sources: int = 20_000


def n_words() -> Column:
    """Number of words between ASCII white space."""
    return F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def order_key(m: Mix) -> Column:
    return F.md5(F.concat(F.lit(f"{m.seed}:"), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce("text", F.lit("")))))


def source_key() -> Column:
    """The source as a join key that is never null."""
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))


def targets(sources: DataFrame, m: Mix) -> DataFrame:
    """Add target to (skey, source, source_size), one row per source."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in m.weights]), ((rank - 1) % len(m.weights) + 1).cast("int"))
    s = sources.withColumn("weight", weight).withColumn("ceiling", F.col("source_size") * F.lit(float(m.most)))
    s = s.withColumn("fill", F.col("ceiling") / F.col("weight"))
    whole = Window.partitionBy()
    order = Window.orderBy("fill", F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("ceiling").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(whole) * F.lit(m.percent / 100)
    s = s.withColumn("level", (total - before) / rest)
    # from the first source that doesn't reach its ceiling on, the level stays
    first = F.min(F.when(F.col("fill") > F.col("level"), F.struct("fill", F.coalesce("source", F.lit("")), F.col("level").alias("found")))).over(whole)
    level = first["found"]
    return s.withColumn("target", F.when(level.isNull() | (F.col("ceiling") <= level * F.col("weight")), F.col("ceiling")).otherwise(level * F.col("weight"))).select("skey", "source", "source_size", "target")


def cuts(sized: DataFrame, m: Mix) -> DataFrame:
    """One row per source: target, whole epochs, and the key at the cut with the words taken of it (cut_key, cut_words)."""
    sums = materialize(sized.groupBy("skey", F.substring("key", 1, m.digits).alias("range")).agg(F.sum("size").alias("size"), F.first("source").alias("source")), "ranges")
    sources = targets(sums.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("source_size")), m)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + F.lit(1e-12))).otherwise(0).cast("long")
    sources = sources.withColumn("epochs", epochs).withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    sources = materialize(sources, "sources")

    at = sources.select("skey", "rest", F.lit(0).cast("long").alias("start"))
    along = Window.partitionBy("skey").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    for digits, wider in ((m.digits, 0), (2 * m.digits, m.digits), (32, 2 * m.digits)):
        if wider:
            own = sized.withColumn("range", F.substring("key", 1, wider)).join(small_or_none(at.select("skey", "range"), m.broadcast_sources), ["skey", "range"])
            sums = own.groupBy("skey", F.substring("key", 1, digits).alias("range")).agg(F.sum("size").alias("size"))
        begin = F.col("start") + F.coalesce(F.sum("size").over(along), F.lit(0))
        placed = sums.select("skey", "range", "size").join(small_or_none(at.select("skey", "rest", "start"), m.broadcast_sources), "skey").withColumn("begin", begin)
        at = materialize(placed.where("begin < rest AND rest <= begin + size").select("skey", "range", "rest", F.col("begin").alias("start")), "at")
    at = at.select("skey", F.col("range").alias("cut_key"), (F.col("rest") - F.col("start")).alias("cut_words"))
    return materialize(sources.join(at, "skey", "left"), "cuts")


def _sized(docs: DataFrame, m: Mix) -> DataFrame:
    """(doc_id, source, size, key, skey, row) of each row, written with its number."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words().alias("size"), order_key(m).alias("key"))
    return materialize(rows.withColumn("skey", source_key()).withColumn("row", F.monotonically_increasing_id()), "sized")


def _words_before(ties: DataFrame) -> DataFrame:
    """Add to written rows (skey, size, row), all with their source's key at the cut, the words of those before them.

    A row's number begins with the part of the table that it was written by; a
    part is as large as one task, however many repeats there are.
    """
    parted = ties.withColumn("_part", F.shiftright("row", 33))
    sums = parted.groupBy("skey", "_part").agg(F.sum("size").alias("_n"))
    start = sums.select("skey", "_part", (F.sum("_n").over(Window.partitionBy("skey").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_start"))
    here = Window.partitionBy("skey", "_part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return parted.join(start, ["skey", "_part"]).withColumn("before", F.col("_start") + F.coalesce(F.sum("size").over(here), F.lit(0))).drop("_part", "_start")


def plan_mix(docs: DataFrame, m: Mix = Mix()) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for each row of docs (doc_id, text, source)."""
    sized = _sized(docs, m)
    rows = sized.join(small_or_none(cuts(sized, m).drop("source"), m.broadcast_sources), "skey")
    at_cut = F.coalesce(F.col("key") == F.col("cut_key"), F.lit(False))
    clear = rows.where(~at_cut).withColumn("part", F.when(F.col("key") < F.col("cut_key"), F.col("size")).otherwise(0))
    ties = _words_before(rows.where(at_cut)).withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("cut_words") - F.col("before"))))
    out = [x.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken")) for x in (clear, ties)]
    return out[0].unionByName(out[1])


def mix(docs: DataFrame, m: Mix = Mix()) -> DataFrame:
    """The documents that the mix takes, each as often as it is begun, with their own columns only.

    The document at a source's cut is kept whole, so that a source has at most
    one document more than its budget.
    """
    at = cuts(_sized(docs, m), m).select("skey", F.struct("epochs", "cut_key", "cut_words").alias("_mix_cut"))
    at = small_or_none(at.withColumnRenamed("skey", "_mix_skey"), m.broadcast_sources)
    rows = docs.withColumn("_mix_own", source_key()).withColumn("_mix_key", order_key(m)).join(at, F.col("_mix_own") == F.col("_mix_skey"))
    at_cut = F.coalesce(F.col("_mix_key") == F.col("_mix_cut.cut_key"), F.lit(False))
    begun = lambda more: F.greatest(F.lit(0), F.col("_mix_cut.epochs") + more.cast("int")).cast("int")
    clear = rows.where(~at_cut).select(*docs.columns, begun(F.coalesce(F.col("_mix_key") < F.col("_mix_cut.cut_key"), F.lit(False))).alias("_mix_times"))
    # the rows of one key are repeats of one id and text, one row as a rule; their own columns are kept in a struct, whatever their names
    ties = rows.where(at_cut).select(F.struct(*docs.columns).alias("_mix_row"), "_mix_cut", F.col("_mix_own").alias("skey"), n_words().alias("size"), F.monotonically_increasing_id().alias("row"))
    ties = _words_before(materialize(ties, "ties")).select("_mix_row.*", begun(F.col("before") < F.col("_mix_cut.cut_words")).alias("_mix_times"))
    both = clear.unionByName(ties)
    return both.where("_mix_times > 0").withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_times")))).select(*docs.columns)
