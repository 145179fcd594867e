"""Near-duplicate documents: a multi-index Hamming join over b-bit MinHash signatures.

A document's set holds the hashes of its distinct word shingles. Its signature
has ``hashes`` minima, of each of which ``bits`` bits are kept. Two signatures'
distance is the number of positions that differ. The positions are split into
``chunks`` chunks; by the pigeonhole principle two signatures with a distance of
at most ``chunks * (errors + 1) - 1`` have a chunk with at most ``errors``
differing positions. Each chunk is therefore indexed once for every choice of
``errors`` positions left out, and every such pair meets under at least one key.

Equal sets are one node from the start. Under a key the nodes are compared with
one hub only, so a group of copies costs its size and not its square; what a hub
doesn't explain is searched with an exact prefix filter (see ``_residual``).
Links are confirmed on the full sets.

Nulls and empties: a null or empty text, or one without words, has an empty set
and is linked with nothing. A row without doc_id is never linked, has a null
component and is kept. Rows that repeat a doc_id are versions of one document.
Further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import materialize, per_batch, small_or_none, text_bytes
from docloom.llm.textkit import SPACED, WordHasher, mix64, random_u64, shingle_hashes
from docloom.operators.components import components


@dataclass(frozen=True)
class NearDup:
    """Parameters of the join; ``percent`` is the least Jaccard similarity."""

    shingle: int = 5
    percent: int = 80
    hashes: int = 64
    chunks: int = 13
    errors: int = 1
    seed: int = 11
    #: Up to so many keys or node ids (8 to 16 bytes each) are broadcast.
    broadcast_rows: int = 1_000_000

    @property
    def distance(self) -> int:
        """All pairs of signatures up to this distance meet."""
        return self.chunks * (self.errors + 1) - 1

    def layout(self) -> list[list[int]]:
        """For each key of a signature, the positions that it is made of."""
        edges = np.linspace(0, self.hashes, self.chunks + 1).astype(int)
        out = []
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            for gone in combinations(range(low, high), self.errors):
                out.append([k for k in range(low, high) if k not in gone])
        return out


def signature(shingles: np.ndarray, p: NearDup) -> np.ndarray:
    """The low 16 bits of the mixed minimum of each hash function."""
    a, b = random_u64(p.seed, p.hashes)[:, None] | np.uint64(1), random_u64(p.seed + 1, p.hashes)[:, None]
    low = np.full(p.hashes, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(shingles), 512):
        np.minimum(low, (shingles[None, k : k + 512] * a + b).min(axis=1), out=low)
    return (mix64(low) & np.uint64(0xFFFF)).astype(np.uint16)


def fingerprints(docs: DataFrame, p: NearDup) -> DataFrame:
    """(doc_id, n_shingles, set_hash, sig) of each row; the hash is a 128-bit sum over the whole set."""
    hasher = WordHasher(SPACED)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, hashes, sigs = [], [], []
        for data in text_bytes(batch):
            s = shingle_hashes(hasher.words(data), p.shingle)
            n.append(len(s))
            if len(s):
                sums = [mix64(s + np.uint64(k)).sum(dtype=np.uint64) for k in (1, 2)]
                hashes.append(np.array(sums, dtype="<u8").tobytes())
                sigs.append(signature(s, p).astype("<u2").tobytes())
            else:
                hashes.append(None)
                sigs.append(None)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(hashes, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "n_shingles", "set_hash", "sig"])

    return per_batch(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_shingles long, set_hash binary, sig binary")


def shingle_sets(docs: DataFrame, p: NearDup) -> DataFrame:
    """(node, shingles) with the sorted full set of each row."""
    hasher = WordHasher(SPACED)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [np.sort(shingle_hashes(hasher.words(x), p.shingle).view(np.int64)) for x in text_bytes(batch)]
        ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
        values = np.concatenate(sets) if sets else np.empty(0, dtype=np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], ["node", "shingles"])

    return per_batch(docs.select(F.col("doc_id").cast("long"), "text"), run, "node long, shingles array<long>")


def index_keys(nodes: DataFrame, p: NearDup) -> DataFrame:
    """(key, node): the keys under which a node's signature is indexed."""
    layout = p.layout()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sigs = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype="<u2").reshape(-1, p.hashes)
        keys = np.empty((len(sigs), len(layout)), dtype=np.uint64)
        for k, places in enumerate(layout):
            key = np.full(len(sigs), k + 1, dtype=np.uint64)
            for place in places:
                key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + sigs[:, place].astype(np.uint64))
            keys[:, k] = key
        ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), len(layout))
        return pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(ids)], ["key", "node"])

    return per_batch(nodes.select("node", "sig"), run, "key long, node long")


@F.pandas_udf(T.IntegerType())
def _sig_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype="int32")
    x, y = (np.frombuffer(b"".join(s), dtype="<u2").reshape(len(s), -1) for s in (a, b))
    return pd.Series((x != y).sum(axis=1).astype("int32"))


def _near_in_signature(pairs: DataFrame, nodes: DataFrame, p: NearDup) -> DataFrame:
    """Drop pairs whose signatures differ in over half of all positions: a pair at the least similarity is that far apart with a chance of about 1e-8."""
    sig = nodes.select("node", "sig")
    both = pairs.join(sig.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), "a").join(sig.select(F.col("node").alias("b"), F.col("sig").alias("sig_b")), "b")
    return both.where(_sig_distance("sig_a", "sig_b") <= max(p.distance, p.hashes // 2)).select("a", "b")


def _confirmed(pairs: DataFrame, sets: DataFrame, p: NearDup) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b"))
    both = F.size(F.array_intersect("set_a", "set_b")).cast("long")
    union = F.size("set_a").cast("long") + F.size("set_b") - F.col("both")
    return pairs.join(a, "a").join(b, "b").withColumn("both", both).where((F.col("both") > 0) & (100 * F.col("both") >= p.percent * union)).select("a", "b")


def _ordered(a: str, b: str) -> tuple[Column, Column]:
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def _residual(multi: DataFrame, hubs: DataFrame, labels: DataFrame, sets: DataFrame, p: NearDup) -> DataFrame:
    """Confirmed links between nodes that share a key but are in different components so far.

    Such a pair has a node that isn't in the component of the key's hub. Sets are
    ordered by how rare a shingle is among the nodes concerned. Two sets of n and
    m shingles with a similarity of s have at least a = s / (1 + s) * (n + m) in
    common, so the first of these is among the first n - a + 1 of the one and
    m - a + 1 of the other; and n and m differ by a factor of at most s. Both
    bounds are exact.
    """
    own = lambda df, node, name: df.join(labels.select(F.col("node").alias(node), F.col("component").alias(name)), node, "left").withColumn(name, F.coalesce(name, node))
    rows = own(own(multi.where("n > 2").join(hubs, "key"), "node", "c"), "hub", "hub_c")
    rows = materialize(rows.select("key", "node", "c", (F.col("c") != F.col("hub_c")).alias("odd")), "rows")
    open_keys = rows.where("odd").select("key").distinct()
    nodes = materialize(rows.join(open_keys, "key", "left_semi").groupBy("node", "c").agg(F.max("odd").alias("odd")), "open")
    words = nodes.join(sets, "node").select("node", "c", "odd", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("shingle"))
    words = materialize(words, "shingles")
    common = words.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    kept = words.join(common, "shingle").withColumn("kept", F.count("*").over(Window.partitionBy("node"))).withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy("df", "shingle")))
    # shingles of one node only come first in the order and match nothing
    prefix = F.col("n") - F.ceil(F.col("n") * p.percent / 100 - F.lit(1e-9)) + 1
    kept = materialize(kept.where((F.col("n") - F.col("kept")) + F.col("rank") <= prefix).select("shingle", "node", "c", "odd", "n", (F.col("n") - F.col("kept") + F.col("rank")).alias("at")), "prefixes")
    a = kept.where("odd").select("shingle", F.col("node").alias("x"), F.col("c").alias("cx"), F.col("n").alias("nx"), F.col("at").alias("ax"))
    b = kept.select("shingle", F.col("node").alias("y"), F.col("c").alias("cy"), F.col("n").alias("ny"), F.col("at").alias("ay"))
    least = F.ceil((F.col("nx") + F.col("ny")) * (p.percent / (100 + p.percent)) - F.lit(1e-9))
    fits = (F.col("cx") != F.col("cy")) & (100 * F.least("nx", "ny") >= p.percent * F.greatest("nx", "ny")) & (F.col("ax") <= F.col("nx") - least + 1) & (F.col("ay") <= F.col("ny") - least + 1)
    pairs = a.join(b, "shingle").where(fits).select(*_ordered("x", "y")).distinct()
    return _confirmed(pairs, sets, p)


def near_duplicates(docs: DataFrame, p: NearDup = NearDup()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text).

    component_id is the smallest doc_id reachable over links; kept marks the row
    that has it as its own.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    prints = materialize(fingerprints(rows, p), "prints")
    named = prints.where("doc_id IS NOT NULL")
    nodes = materialize(named.where("n_shingles > 0").groupBy("set_hash").agg(F.min("doc_id").alias("node"), F.max("sig").alias("sig")), "nodes")
    # counts are summed before the shuffle, so a key of many nodes is no task's burden; keys are cheaper made twice than kept
    shared = materialize(index_keys(nodes, p).groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    multi = materialize(index_keys(nodes, p).join(small_or_none(shared, p.broadcast_rows), "key"), "multi")

    # the hub of a key is the node that meets most others, over all its keys
    weight = multi.groupBy("node").agg(F.sum("n").alias("weight"))
    best = F.max(F.struct("weight", (-F.col("node")).alias("order")))
    hubs = materialize(multi.join(weight, "node").groupBy("key").agg((-best["order"]).alias("hub")), "hubs")
    pairs = multi.join(hubs, "key").where("node <> hub").select(*_ordered("node", "hub")).distinct()
    pairs = materialize(_near_in_signature(pairs, nodes, p), "pairs")

    wide = multi.where("n > 2").select("node")
    ids = materialize(reduce(DataFrame.unionByName, [wide, pairs.select(F.col("a").alias("node")), pairs.select(F.col("b").alias("node"))]).distinct(), "ids")
    found = rows.join(small_or_none(ids.withColumnRenamed("node", "doc_id"), p.broadcast_rows), "doc_id")
    sets = materialize(shingle_sets(found, p), "sets")

    links = materialize(_confirmed(pairs, sets, p), "links")
    labels = components(links)
    more = materialize(_residual(multi, hubs, labels, sets, p), "more")
    if more.limit(1).count():
        labels = components(links.unionByName(more))

    at = nodes.join(labels, "node", "left").select("set_hash", F.coalesce("component", "node").alias("component"))
    out = named.join(at, "set_hash", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    out = out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    null = prints.where("doc_id IS NULL").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(null)
