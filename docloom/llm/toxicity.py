"""Toxicity: a linear classifier of words, regularised with counterfactual sentences.

Features are hashed words and their first bytes, present or not. The classifier
is fitted on a bounded sample of labelled rows by accelerated proximal gradient
with an L1 penalty. Every sampled text has a counterfactual: its identity terms
are exchanged for others of the same language; a text without one gets one, as a
neutral mention, at the rate ``inserted``. The squared change of the score
(before the logistic function) is added to the loss, so that naming a group, or
another group, doesn't move a score.

Labels are used only where crc32(doc_id as text) mod ``folds`` is not 0. Scores
depend on the text alone. Nulls and empties: a null or empty text gets the score
of the intercept; null labels and labels without a document are left out; of
several labels of a doc_id the highest counts; without labels all scores are
low. Repeated rows are scored alike. Further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import materialize, per_batch, text_bytes
from docloom.llm.textkit import ALNUM, WordHasher

#: Identity terms by language. Each is exchanged for the next one of its language.
IDENTITIES = (
    ("women", "men", "muslims", "christians", "jews", "hindus", "immigrants", "refugees", "gay", "straight", "black", "white", "asian", "latino", "disabled", "elderly"),
    ("femmes", "hommes", "musulmans", "chrétiens", "juifs", "hindous", "immigrés", "réfugiés", "homosexuels", "hétérosexuels", "noirs", "blancs", "asiatiques", "handicapés"),
    ("frauen", "männer", "muslime", "christen", "juden", "hindus", "einwanderer", "flüchtlinge", "homosexuelle", "heterosexuelle", "schwarze", "weiße", "asiaten", "behinderte"),
    ("mujeres", "hombres", "musulmanes", "cristianos", "judíos", "hindúes", "inmigrantes", "refugiados", "homosexuales", "heterosexuales", "negros", "blancos", "asiáticos", "discapacitados"),
)


@dataclass(frozen=True)
class Toxicity:
    #: Labelled rows that the fit sees at most; they are chosen by a hash of doc_id.
    sample: int = 20_000
    folds: int = 5
    bits: int = 18
    prefixes: tuple[int, ...] = (4, 6)
    #: Features that the fit keeps, those that differ most between the classes, and those of identity terms.
    features: int = 4096
    l1: float = 4e-4
    counterfactual: float = 1.0
    #: Share of the texts without an identity term that get one as their counterfactual.
    inserted: float = 1.0
    rounds: int = 300
    identities: tuple[tuple[str, ...], ...] = IDENTITIES

    @property
    def size(self) -> int:
        return (1 + len(self.prefixes)) << self.bits


def fold(doc_id: Column, p: Toxicity) -> Column:
    return F.crc32(doc_id.cast("string")) % p.folds


def _features(hasher: WordHasher, data: bytes, p: Toxicity) -> np.ndarray:
    """Sorted distinct feature numbers; words and each length of prefix have regions of their own."""
    low = np.uint64((1 << p.bits) - 1)
    regions = hasher.prefixes(data, [None, *p.prefixes])
    return np.unique(np.concatenate([(r & low).astype(np.int32) + (k << p.bits) for k, r in enumerate(regions)]))


def counterfactual(p: Toxicity) -> Callable[[bytes], bytes]:
    """A function from a text to its counterfactual; equal if it has none."""
    after: dict[bytes, bytes] = {}
    for terms in p.identities:
        for a, b in zip(terms, [*terms[1:], *terms[:1]], strict=True):
            after.setdefault(a.encode(), b.encode())
    # where no term is near, the fast search for any of them is all that is done
    pattern = re.compile(rb"(?<![0-9A-Za-z\x80-\xff])(" + b"|".join(map(re.escape, sorted(after))) + rb")(?![0-9A-Za-z\x80-\xff])", re.I)
    terms = sorted(after)

    def run(data: bytes) -> bytes:
        other = pattern.sub(lambda m: after.get(m[0].lower(), m[0]), data)
        if other != data:
            return other
        mark = zlib.crc32(data)
        return data + b" " + terms[mark % len(terms)] if (mark >> 8) % 1000 < p.inserted * 1000 else data

    return run


def training_rows(docs: DataFrame, labels: DataFrame, p: Toxicity) -> DataFrame:
    """(doc_id, toxic, features, gone, come) of the sample: the features of a text, and those that its counterfactual loses and gains (null without one)."""
    marks = labels.where(F.col("toxic").isNotNull() & (fold(F.col("doc_id"), p) != 0)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")  # at most p.sample rows
    # rows that repeat a doc_id are versions of one document: the least text of each is learnt from, so that the sample is bounded
    rows = rows.groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min(F.coalesce("text", F.lit(""))).alias("text"))
    hasher, other = WordHasher(ALNUM), counterfactual(p)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, gone, come = [], [], []
        for data in text_bytes(batch):
            own.append(_features(hasher, data, p))
            changed = other(data)
            there = _features(hasher, changed, p) if changed != data else None
            gone.append(None if there is None else np.setdiff1d(own[-1], there, assume_unique=True))
            come.append(None if there is None else np.setdiff1d(there, own[-1], assume_unique=True))
        kind = pa.list_(pa.int32())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(x, kind) for x in (own, gone, come)]], ["doc_id", "toxic", "features", "gone", "come"])

    return per_batch(rows, run, "doc_id long, toxic int, features array<int>, gone array<int>, come array<int>")


def chosen_features(rows: DataFrame, p: Toxicity) -> np.ndarray:
    """The features that the fit keeps, sorted: counted in each partition, summed by a shuffle, and ranked; at most twice ``p.features`` reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((3, p.size), dtype=np.int64)
        for batch in batches:
            toxic = batch.column(0).to_numpy(zero_copy_only=False)
            for row, name in ((1, "features"), (2, "gone"), (2, "come")):
                at = batch.schema.get_field_index(name)
                lengths, values = _flat(batch.column(at))
                if row == 2:
                    count[2] += np.bincount(values, minlength=p.size)
                    continue
                positive = np.repeat(toxic == 1, lengths)
                for k in (0, 1):
                    count[k] += np.bincount(values[positive == bool(k)], minlength=p.size)
        there = np.flatnonzero(count.any(axis=0)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(there), *[pa.array(c[there]) for c in count]], ["feature", "clean", "toxic", "named"])

    counts = rows.select("toxic", "features", "gone", "come").mapInArrow(run, "feature int, clean long, toxic long, named long")
    counts = counts.groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("clean", "toxic", "named")])
    total = rows.agg(F.count_if(F.col("toxic") == 0).alias("clean"), F.count_if(F.col("toxic") == 1).alias("toxic")).first()
    rate = {k: (F.col(k) + 0.5) / (total[k] + 1) for k in ("clean", "toxic")}
    spread = F.sqrt(rate["clean"] * (1 - rate["clean"]) / max(1, total["clean"]) + rate["toxic"] * (1 - rate["toxic"]) / max(1, total["toxic"]))
    ranked = counts.where("clean + toxic >= 3").select("feature", (F.abs(rate["toxic"] - rate["clean"]) / spread).alias("gap"), "named")
    best = [ranked.orderBy(F.desc("gap"), "feature").limit(p.features), ranked.where("named > 0").orderBy(F.desc("named"), "feature").limit(p.features)]
    return np.unique(np.concatenate([b.select("feature").toArrow()["feature"].to_numpy() for b in best])).astype(np.int32)


@dataclass(frozen=True)
class Model:
    """The weights that aren't 0, by feature number, the intercept, and how many counterfactual pairs the fit used."""

    index: np.ndarray
    weight: np.ndarray
    intercept: float
    pairs: int = 0


def _flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Row lengths and values of a list column; nulls have length 0."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), flat.flatten().to_numpy()


def _sparse(rows: tuple[np.ndarray, np.ndarray], chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and place among the chosen features of each that is present."""
    lengths, values = rows
    at = np.minimum(np.searchsorted(chosen, values), len(chosen) - 1).astype(np.int32)
    there = chosen[at] == values
    return np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)[there], at[there]


def _top(f: Callable[[np.ndarray], np.ndarray], n: int) -> float:
    """The largest eigenvalue of a symmetric map, by power iteration."""
    u, top = np.ones(n) / np.sqrt(n), 0.0
    for k in range(30):
        u = f(u + (1e-3 * np.cos(np.arange(n)) if k == 0 else 0))
        top = float(np.linalg.norm(u))
        if top == 0:
            return 0.0
        u = u / top
    return top


def fit(rows: pa.Table, chosen: np.ndarray, p: Toxicity) -> Model:
    """Fit the chosen features' weights w and the intercept c on rows (doc_id, toxic, features, gone, come).

    The loss is the mean logistic loss, ``l1`` times the sum of |w|, and
    ``counterfactual`` times the mean squared change of the score over the pairs.
    """
    rows = rows.sort_by("doc_id")
    y = rows["toxic"].to_numpy().astype(float)
    n, prior = len(y), (y.sum() + 0.1) / (len(y) + 1)
    b = float(np.log(prior / (1 - prior)))
    empty = Model(np.zeros(1, dtype=np.int32), np.zeros(1), b)
    if n == 0 or y.min() == y.max() or not len(chosen):
        return empty
    row, col = _sparse(_flat(rows["features"]), chosen)
    gone, come = _sparse(_flat(rows["gone"]), chosen), _sparse(_flat(rows["come"]), chosen)
    pairs = int(rows["come"].is_valid().to_numpy().sum())
    apply = lambda w, at: np.bincount(at[0], weights=w[at[1]], minlength=n).astype(float)
    back = lambda r, at: np.bincount(at[1], weights=r[at[0]], minlength=len(chosen)).astype(float)
    change = lambda v: apply(v, come) - apply(v, gone)
    changed_back = lambda d: back(d, come) - back(d, gone)
    curve, pull = 0.25 / n * _top(lambda v: back(apply(v, (row, col)), (row, col)), len(chosen)), 2 * p.counterfactual / max(1, pairs)
    if pairs:
        curve += pull * _top(lambda v: changed_back(change(v)), len(chosen))
    w = v = np.zeros(len(chosen))
    c, momentum, step = b, 1.0, 1.0 / (1.1 * curve + 1.0)
    for _ in range(p.rounds):
        r = 1 / (1 + np.exp(-(apply(v, (row, col)) + c))) - y
        g = back(r, (row, col)) / n
        if pairs:
            g += pull * changed_back(change(v))
        nxt = v - step * g
        nxt = np.sign(nxt) * np.maximum(0, np.abs(nxt) - step * p.l1)
        c -= step * 4 * r.mean()
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        v = nxt + (momentum - 1) / after * (nxt - w)
        w, momentum = nxt, after
    keep = np.flatnonzero(w)
    return Model(chosen[keep], w[keep], float(c), pairs) if len(keep) else Model(empty.index, empty.weight, b, pairs)


class _Scorer:
    """Scores texts in a task; the dense weights are a broadcast of fixed size."""

    def __init__(self, docs: DataFrame, model: Model, p: Toxicity):
        dense = np.zeros(p.size, dtype=np.float64)
        dense[model.index] = model.weight
        self.weights = docs.sparkSession.sparkContext.broadcast(dense)
        self.intercept, self.p, self.hasher = model.intercept, p, WordHasher(ALNUM)

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        weights, low = self.weights.value, np.uint64((1 << self.p.bits) - 1)
        out = np.full(len(texts), self.intercept)
        for n, data in enumerate(texts):
            for k, r in enumerate(self.hasher.prefixes(data, [None, *self.p.prefixes])):
                f = (r & low).astype(np.int64) + (k << self.p.bits)
                out[n] += weights[np.unique(f[weights[f] != 0])].sum()
        return 1 / (1 + np.exp(-out))


def score(docs: DataFrame, model: Model, p: Toxicity = Toxicity()) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs (doc_id, text)."""
    scorer = _Scorer(docs, model, p)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = scorer(text_bytes(batch))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    scored = per_batch(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), p) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def trained(docs: DataFrame, labels: DataFrame, p: Toxicity = Toxicity()) -> Model:
    """The classifier of these documents and labels (doc_id, toxic).

    Only the chosen features of the sample reach the driver: at most ``sample``
    rows of at most twice ``features`` numbers, however long the texts are.
    """
    rows = materialize(training_rows(docs, labels, p), "training")
    chosen = chosen_features(rows, p)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        kind, out = pa.list_(pa.int32()), [batch.column(0), batch.column(1)]
        for k in (2, 3, 4):
            lengths, values = _flat(batch.column(k))
            there = np.isin(values, chosen)
            at = np.concatenate([[0], np.cumsum(np.bincount(np.repeat(np.arange(len(lengths)), lengths)[there], minlength=len(lengths)))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(values[there], pa.int32()), mask=batch.column(k).is_null() if len(lengths) else None)
            out.append(lists.cast(kind))
        return pa.RecordBatch.from_arrays(out, batch.schema.names)

    return fit(per_batch(rows, run, rows.schema).toArrow(), chosen, p)


def keep_clean(docs: DataFrame, model: Model, p: Toxicity = Toxicity()) -> DataFrame:
    """The documents that aren't predicted toxic, with their own columns only."""
    scorer, at = _Scorer(docs, model, p), docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(scorer(text_bytes(pa.RecordBatch.from_arrays([batch.column(at)], ["text"]))) < 0.5))

    return per_batch(docs, run, docs.schema)
