"""Benchmark decontamination: a prefix-filtered set join of items' windows with documents.

A window is ``window`` consecutive words of an item; an item with fewer words is
one window. A window lies in a document only if all its shingles do, so the
prefix of a window that must be joined is its one rarest shingle, where shingles
are ordered by how often they occur in all documents. The shingle's place in the
window gives the window's place in the document (positional bound), which must
lie inside the document (length bound); then all words are compared.

Items are taken in blocks of at most ``block`` windows. A block's prefixes are
what is broadcast; a larger benchmark makes more blocks, each of which is held
against all documents.

Nulls and empties: null and empty texts have no words and no hits; items without
words have no windows; items with a null id are named by an empty string.
Repeated items count once by id; repeated documents have a row each. Further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import materialize, per_batch, pieces, text_bytes
from docloom.llm.textkit import ALNUM, WordHasher, mix64


@dataclass(frozen=True)
class Decontam:
    window: int = 10
    shingle: int = 3
    #: Windows of a block; a window takes about 200 bytes on each executor.
    block: int = 200_000


def _runs(words: np.ndarray, width: int) -> np.ndarray:
    """The hash of each run of ``width`` words, by its first word's position."""
    n = max(0, len(words) - width + 1)
    out = np.full(n, width, dtype=np.uint64)
    for k in range(width):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n] + np.uint64(k + 1))
    return out


def item_windows(items: DataFrame, p: Decontam) -> DataFrame:
    """(item, words, shingles) of each distinct window of items (item_id, text); words are 64-bit hashes."""
    hasher = WordHasher(ALNUM)
    longs = pa.list_(pa.int64())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, words, shingles = [], [], []
        for name, data in zip(batch.column(0).to_pylist(), text_bytes(batch), strict=True):
            w = hasher.words(data)
            size = min(p.window, len(w))
            for k in range(len(w) - size + 1 if size else 0):
                names.append(name or "")
                words.append(w[k : k + size].view(np.int64))
                shingles.append(_runs(w[k : k + size], min(p.shingle, size)).view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(words, longs), pa.array(shingles, longs)], ["item", "words", "shingles"])

    return per_batch(items.select(F.col("item_id").cast("string"), "text"), run, "item string, words array<long>, shingles array<long>").distinct()


def _occurrences(docs: DataFrame, shingles: np.ndarray, widths: list[int]) -> DataFrame:
    """(shingle, n): how often each of the given shingles occurs in the documents, one row per shingle and batch."""
    hasher, known = WordHasher(ALNUM), docs.sparkSession.sparkContext.broadcast(np.sort(shingles))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        order = known.value
        counts = np.zeros(len(order), dtype=np.int64)
        for data in text_bytes(batch):
            w = hasher.words(data)
            for width in widths:
                at, hit = _find(order, _runs(w, width))
                np.add.at(counts, at[hit], 1)
        seen = np.flatnonzero(counts)
        return pa.RecordBatch.from_arrays([pa.array(order[seen].view(np.int64)), pa.array(counts[seen])], ["shingle", "n"])

    return per_batch(docs.select("text"), run, "shingle long, n long")


def _find(order: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each value would stand in a sorted array, and whether it is there."""
    at = np.minimum(np.searchsorted(order, values), len(order) - 1)
    return at, order[at] == values


def _candidates(docs: DataFrame, shingles: np.ndarray, widths: list[int], p: Decontam) -> DataFrame:
    """(row, doc_id, n_words, at) of each document; at has the places of prefix shingles, each with the words around."""
    hasher, known = WordHasher(ALNUM), docs.sparkSession.sparkContext.broadcast(np.sort(shingles))
    kind = pa.list_(pa.struct([("shingle", pa.int64()), ("pos", pa.int32()), ("first", pa.int32()), ("around", pa.list_(pa.int64()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, seen, task = known.value, 0, TaskContext.get().partitionId() << 40
        for batch in pieces(batches):
            lengths, places = [], []
            for data in text_bytes(batch):
                w = hasher.words(data)
                lengths.append(len(w))
                found = []
                for width in widths:
                    runs = _runs(w, width)
                    for pos in np.flatnonzero(_find(order, runs)[1]).tolist():
                        first = max(0, pos - p.window + width)
                        found.append({"shingle": int(runs[pos].view(np.int64)), "pos": pos, "first": first, "around": w[first : pos + p.window].view(np.int64)})
                places.append(found)
            rows = task + np.arange(seen, seen + len(lengths))
            seen += len(lengths)
            yield pa.RecordBatch.from_arrays([pa.array(rows), batch.column(0), pa.array(lengths, pa.int64()), pa.array(places, kind)], ["row", "doc_id", "n_words", "at"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "row long, doc_id long, n_words long, at array<struct<shingle:long,pos:int,first:int,around:array<long>>>")


def _block_hits(docs: DataFrame, windows: DataFrame, p: Decontam) -> DataFrame:
    """(row, doc_id, n_words, hit): a row for each document and candidate; hit is null or the window's start, stop and item."""
    terms = windows.select(F.explode("shingles").alias("shingle"), F.size("words").alias("size")).select("shingle", F.least("size", F.lit(p.shingle)).alias("width")).distinct().toArrow()
    widths = sorted(set(terms["width"].to_pylist()))
    shingles = np.unique(terms["shingle"].to_numpy()).view(np.uint64)
    counts = materialize(_occurrences(docs, shingles, widths).groupBy("shingle").agg(F.sum("n").alias("n")), "rarity")

    rarest = F.min(F.struct("n", "offset", "shingle"))
    prefixes = windows.select("item", "words", F.posexplode("shingles").alias("offset", "shingle")).join(counts, "shingle", "left")
    prefixes = prefixes.groupBy("item", "words").agg(rarest.alias("least")).where("least.n IS NOT NULL")  # a shingle that no document has: no occurrence
    whole = windows.select("item", "words", F.size("shingles").alias("size"))
    known = windows.select("item", "words", F.explode("shingles").alias("shingle")).join(counts, "shingle").groupBy("item", "words").agg(F.count("*").alias("there"))
    prefixes = prefixes.join(whole, ["item", "words"]).join(known, ["item", "words"]).where("there = size")
    prefixes = materialize(prefixes.select("item", "words", F.col("least.offset").alias("offset"), F.col("least.shingle").alias("shingle")), "prefixes")

    joined = prefixes.select("shingle").distinct().toArrow()["shingle"].to_numpy().view(np.uint64)
    if not len(joined):
        joined = np.zeros(1, dtype=np.uint64)
    places = _candidates(docs, joined, widths, p).select("row", "doc_id", "n_words", F.explode_outer("at").alias("at"))
    places = places.select("row", "doc_id", "n_words", "at.*")
    found = places.join(F.broadcast(prefixes), "shingle", "left")  # at most p.block rows
    start = F.col("pos") - F.col("offset")
    fits = (start >= 0) & (start + F.size("words") <= F.col("n_words"))
    same = F.slice("around", F.greatest(start - F.col("first") + 1, F.lit(1)), F.size("words")) == F.col("words")
    hit = F.when(F.col("words").isNotNull() & fits & same, F.struct(start.alias("start"), (start + F.size("words")).alias("stop"), F.col("item").alias("item")))
    return found.select("row", "doc_id", "n_words", hit.alias("hit"))


def contamination(docs: DataFrame, items: DataFrame, p: Decontam = Decontam()) -> DataFrame:
    """(doc_id, n_words, n_hit, items) for each row of docs (doc_id, text); items are sorted item_ids as strings."""
    windows = materialize(item_windows(items, p), "windows")
    count = windows.count()
    if count > p.block:
        blocks = -(-count // max(1, p.block * 9 // 10))  # a tenth is left free, since hashes don't deal evenly
        windows = materialize(windows.withColumn("block", F.pmod(F.xxhash64("words", "item"), F.lit(blocks))), "windows")
        docs = materialize(docs.select("doc_id", "text"), "texts")  # rows have the same numbers for each block
        hits = reduce(DataFrame.unionByName, [materialize(_block_hits(docs, windows.where(F.col("block") == k).drop("block"), p), "hits") for k in range(blocks)])
    else:
        hits = _block_hits(docs, windows, p)
    spans = F.array_sort(F.collect_set(F.struct("hit.start", "hit.stop")))
    by_row = hits.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.filter(spans, lambda x: x["start"].isNotNull()).alias("spans"), F.array_sort(F.collect_set("hit.item")).alias("items"))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, x: F.struct(F.greatest(acc["end"], x["stop"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(acc["end"], x["start"]))).cast("long").alias("n"))
    return by_row.select("doc_id", "n_words", F.aggregate("spans", zero, step)["n"].alias("n_hit"), "items")
