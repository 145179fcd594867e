"""Chat formatting: a dialogue rendered once from the perspective of each participant.

For every speaker of a conversation, that speaker's turns become the assistant's,
the others' turns are users' with the speakers' names, and system turns stay. The
loss mask covers what the assistant says, with its closing mark. A row is one
turn of one perspective, with its place in the rendered dialogue, so a conversation
of any length needs no task of its own: places are prefix sums over blocks of turns,
then within a block. ``dialogues`` puts the segments together, in parts of a bounded
length. Turns stand in the order of turn, then of role and segment, nulls first.

Marks in a text are broken up, so a turn can't forge another. Nulls and empties:
a null or empty text is an empty turn; a null role is a user without a name and
no participant; a null conv_id is one conversation. Repeated rows are repeated
turns. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLOSE = "<|end|>\n"


def _clean(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


#: So many turns are a block, whose places are summed in one task.
BLOCK = 256


def rotate(turns: DataFrame, system_roles: tuple[str, ...] = ("system",)) -> DataFrame:
    """(conv_id, perspective, turn, role, name, segment, start, mask_start, mask_stop) of turns (conv_id, turn, role, text).

    ``start`` is the segment's place in the rendered dialogue. The mask is a span
    of code points of the dialogue, end exclusive, and empty for others' turns.
    """
    is_system = F.col("speaker").isin(*system_roles)
    rows = turns.select("conv_id", "turn", F.col("role").alias("speaker"), "text")
    sides = rows.where(F.col("speaker").isNotNull() & ~is_system).select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("perspective")).distinct()
    each = rows.join(sides, F.col("conv_id").eqNullSafe(F.col("_conv")))
    own = F.coalesce(F.col("speaker") == F.col("perspective"), F.lit(False))
    role = F.when(own, "assistant").when(F.coalesce(is_system, F.lit(False)), "system").otherwise("user")
    each = each.withColumn("role", role).withColumn("name", F.when(F.col("role") == "user", F.col("speaker")))
    head = F.concat(F.lit("<|"), F.col("role"), F.when(F.col("name").isNotNull(), F.concat(F.lit(" name="), _clean(F.col("name")))).otherwise(""), F.lit("|>\n"))
    each = each.withColumn("segment", F.concat(head, _clean(F.col("text")), F.lit(CLOSE)))
    # keys without nulls, so that the join's partitions serve the window too
    key = {"_c": F.coalesce(F.concat(F.lit("s"), F.col("conv_id").cast("string")), F.lit("n")), "_b": F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 63)))}
    each = each.select("conv_id", "perspective", "turn", "speaker", "role", "name", "segment", F.length(head).alias("_head"), F.length("segment").cast("long").alias("_size"), *[v.alias(k) for k, v in key.items()])

    sums = each.groupBy("_c", "perspective", "_b").agg(F.sum("_size").alias("_n"))
    before = Window.partitionBy("_c", "perspective").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.select("_c", "perspective", "_b", (F.sum("_n").over(before) - F.col("_n")).alias("_before"))
    here = Window.partitionBy("_c", "perspective", "_b").orderBy(*[F.col(c).asc_nulls_first() for c in ("turn", "speaker", "segment")]).rowsBetween(Window.unboundedPreceding, 0)
    placed = each.join(sums, ["_c", "perspective", "_b"]).withColumn("start", (F.col("_before") + F.sum("_size").over(here) - F.col("_size")).cast("long"))
    stop = F.col("start") + F.col("_size")
    mask = F.when(F.col("role") == "assistant", F.col("start") + F.col("_head")).otherwise(stop)
    return placed.select("conv_id", "perspective", "turn", "role", "name", "segment", "start", mask.alias("mask_start"), stop.alias("mask_stop"))


def dialogues(rotated: DataFrame, most: int = 1_000_000) -> DataFrame:
    """(conv_id, perspective, part, start, text, masks): rendered dialogues, with the spans of their masks.

    A dialogue is cut before each segment that begins at or beyond a multiple of
    ``most`` code points, so that no part grows with a conversation; starts and
    masks count from the dialogue's beginning.
    """
    piece = F.struct("start", "segment", "mask_start", "mask_stop")
    parts = rotated.groupBy("conv_id", "perspective", F.floor(F.col("start") / most).alias("part")).agg(F.array_sort(F.collect_list(piece)).alias("s"))
    masks = F.transform(F.filter("s", lambda x: x["mask_start"] < x["mask_stop"]), lambda x: F.struct(x["mask_start"].alias("start"), x["mask_stop"].alias("stop")))
    return parts.select("conv_id", "perspective", "part", F.col("s")[0]["start"].alias("start"), F.array_join(F.transform("s", lambda x: x["segment"]), "").alias("text"), masks.alias("masks"))
