"""Language-model scoring: an interpolated modified Kneser-Ney n-gram model.

Spark counts; the model is files of sorted hash arrays, which workers map into
memory to score texts.

1. Words are hashed and counted by a plain aggregation, sorted by hash and written
   as arrays; a word's id is its place among all words.
2. Each task counts the n-grams of its documents and sends them, packed, to buckets.
   A bucket's grams have their context's hash in common modulo the number of buckets,
   so a context's sums are made where its grams are. Contexts of hot words only (a
   word is hot if it holds more than a bucket's share of all tokens, so there are
   at most as many hot words as buckets) are spread by the whole gram's hash and their
   sums are added up in a further shuffle.
3. A bucket's merged grams are one file; their distinct suffixes are the grams of the
   next lower order, counted by distinct left neighbours, and so on down to words.

With count c, the context's sum S of counts, and n1, n2, n3 followers counted once, twice
and more often, p = (max(c - D(c), 0) + (D1 n1 + D2 n2 + D3 n3) p') / S, p' being that of
the order below; an unseen context leaves p' as it is; below words stands 1 / (V + 1).
D1, D2, D3 follow from how many grams of an order are counted 1 to 4 times
(Chen and Goodman, 1998); where one of these is 0, they are 0.5, 1 and 1.5.

A text is lower-cased (A-Z), its words lie between ASCII white space, and an end
follows, which is a token. Before it stand order - 1 start marks, which are counted
as contexts only. Null and empty texts are an end alone. Rows that repeat are counted
as often as they stand there; a null doc_id is the empty text in the fold's rule. Further
columns are ignored. Without any training text, all probabilities are 1.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.arrays import find, mapped, small, write_arrays
from docloom.llm.common import materialize, pieces, scratch, text_bytes
from docloom.llm.textkit import SPACED, WordHasher, mix64, random_u64

_HASHER = WordHasher(SPACED)
#: The end's hash among those of words.
END = random_u64(101, 1).view(np.int64)[0]
_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class KneserNey:
    """``order``: words of the longest n-grams; ``bucket``: about so many tokens have their n-grams in one bucket; ``chunk``: so many are counted at once in a task."""

    order: int = 2
    bucket: int = 1_000_000
    chunk: int = 1_000_000


@dataclass
class Level:
    """One order's discounts, and the sums of the empty context."""

    discounts: tuple[float, float, float]
    total: int
    ones: int
    twos: int
    more: int


@dataclass
class Model:
    """Where the arrays lie, and what is small."""

    folder: str
    order: int
    buckets: int
    tokens: int
    words: int
    #: of each file of words, the least hash and how many words are before it
    firsts: np.ndarray
    bases: np.ndarray
    hot: np.ndarray
    levels: list[Level] = field(default_factory=list)

    @property
    def start(self) -> int:
        return self.words

    @property
    def id_type(self) -> np.dtype:
        return np.dtype("<u4" if self.words + 2 < 1 << 32 else "<u8")

    def word_ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For sorted hashes, the words' ids and training counts; an unknown word's id is words + 1 and its count 0."""
        ids, counts = np.full(len(hashes), self.words + 1, dtype=self.id_type), np.zeros(len(hashes), dtype=np.int64)
        cuts = np.append(np.searchsorted(hashes, self.firsts), len(hashes))
        for k in range(len(self.firsts)):
            low, high = cuts[k], cuts[k + 1]
            if low < high:
                own = mapped(self.folder, f"words-{self.firsts[k]}")
                at, there = find(own["hash"], hashes[low:high])
                ids[low:high][there] = (at[there] + self.bases[k]).astype(self.id_type)
                counts[low:high][there] = own["count"][at[there]]
        return ids, counts

    def hot_context(self, cols: list[np.ndarray]) -> np.ndarray:
        """Whether a gram's context has hot words (or starts) only."""
        out = np.ones(len(cols[0]), dtype=bool)
        for c in cols[:-1]:
            out &= np.isin(c, self.hot) | (c == self.start)
        return out

    def place(self, cols: list[np.ndarray]) -> np.ndarray:
        """The grams' buckets."""
        by = np.where(self.hot_context(cols), _key(cols), _key(cols[:-1]) if len(cols) > 1 else 0)
        return (mix64(by) % np.uint64(self.buckets)).astype(np.int64)


def _key(cols: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of each row of word ids."""
    out = np.zeros(len(cols[0]), dtype=np.uint64)
    for c in cols:
        out = mix64(out * _STEP + c.astype(np.uint64) + np.uint64(1))
    return out


def held_out(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    """Whether a document is in the fold that the model doesn't learn from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def _tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all texts' tokens, one text after the other, and how many each has."""
    words = [_HASHER.words(data).view(np.int64) for data in text_bytes(batch)]
    sizes = np.array([len(w) + 1 for w in words], dtype=np.int64)
    flat = np.full(int(sizes.sum()), END)
    for w, stop in zip(words, np.cumsum(sizes), strict=True):
        flat[stop - len(w) - 1 : stop - 1] = w
    return flat, sizes


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tokens of about so many at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    total = 0
    for batch in pieces(batches):
        held.append(_tokens(batch))
        total += len(held[-1][0])
        if total >= most:
            yield np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
            held, total = [], 0
    if total:
        yield np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])


def _count_words(texts: DataFrame, p: KneserNey) -> DataFrame:
    """(hash, count) of each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for flat, _ in _chunks(batches, p.chunk):
            words, n = np.unique(flat, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(n)], ["hash", "n"])

    return texts.mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def _write_words(words: DataFrame, folder: str) -> DataFrame:
    """Write the words in order of hash; (first, size) of each file."""
    n = max(1, math.ceil(words.count() / 4_000_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), schema=pa.schema([("hash", pa.int64()), ("n", pa.int64())]))
        if table.num_rows:  # the range of one file, a few million words
            hashes = table["hash"].to_numpy()
            first = int(hashes[0])
            write_arrays(folder, f"words-{first}", {"hash": hashes, "count": table["n"].to_numpy()})
            yield pa.RecordBatch.from_pylist([{"first": first, "size": table.num_rows}])

    return words.repartitionByRange(n, "hash").sortWithinPartitions("hash").mapInArrow(run, "first long, size long")


def _grams(ids: np.ndarray, sizes: np.ndarray, k: int, start: int) -> list[np.ndarray]:
    """The k-gram that ends at each token, as k columns of ids."""
    place = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = []
    for back in range(k - 1, -1, -1):
        col = np.full(len(ids), start, dtype=ids.dtype)
        col[back:] = ids[: len(ids) - back]
        col[place < back] = start
        out.append(col)
    return out


def _summed(cols: list[np.ndarray], counts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Distinct grams in order of their hash: hashes, columns and sums of counts."""
    keys = _key(cols)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, dtype=np.int64)
    return keys[at], [c[order[at]] for c in cols], np.add.reduceat(counts[order], at) if len(at) else counts[:0]


#: kind 0: an order's statistics, 1: sums of hot contexts, 2: grams of the next order
_PACKED = "kind int, bucket long, stats array<long>, data binary"


def _packed(kind: int, bucket: int, stats: list[int], arrays: list[np.ndarray]) -> pa.RecordBatch:
    data = b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    types = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip([kind, bucket, stats, data], types, strict=True)], ["kind", "bucket", "stats", "data"])


def _dealt(model: Model, cols: list[np.ndarray], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Distinct grams packed by bucket; within it, in order of their words, so that they compress."""
    bucket = model.place(cols)
    order = np.lexsort([*cols[::-1], bucket])
    cuts = np.searchsorted(bucket[order], np.arange(model.buckets + 1))
    for b in np.flatnonzero(np.diff(cuts)):
        own = order[cuts[b] : cuts[b + 1]]
        yield _packed(2, int(b), [len(own)], [*[c[own] for c in cols], counts[own].astype("<u8" if counts.max() >> 32 else "<u4")])


def _unpacked(rows: list[dict], k: int, kind: np.dtype) -> tuple[list[np.ndarray], np.ndarray]:
    cols, counts = [[] for _ in range(k)], []
    for r in rows:
        n, data = r["stats"][0], r["data"]
        for j in range(k):
            cols[j].append(np.frombuffer(data, dtype=kind, count=n, offset=j * n * kind.itemsize))
        at = k * n * kind.itemsize
        counts.append(np.frombuffer(data, dtype=f"<u{(len(data) - at) // n}", count=n, offset=at).astype(np.int64))
    return [np.concatenate(c) for c in cols], np.concatenate(counts)


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows of one bucket at a time, from rows in order of bucket."""
    bucket, rows = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if rows and r["bucket"] != bucket:
                yield bucket, rows
                rows = []
            bucket = r["bucket"]
            rows.append(r)
    if rows:
        yield bucket, rows


def _contexts(keys: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
    """Sums by context: of counts, and of followers counted once, twice and more often."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, dtype=np.int64)
    sums = lambda x: np.add.reduceat(x.astype(np.int64), at) if len(at) else np.empty(0, dtype=np.int64)
    return {"key": keys[at], "total": sums(counts), "ones": sums(counts == 1), "twos": sums(counts == 2), "more": sums(counts > 2)}


def _write_context(model: Model, name: str, c: dict[str, np.ndarray]) -> None:
    write_arrays(model.folder, name, {"key": c["key"]} | {k: small(v) for k, v in c.items() if k != "key"})


def _merge(grams: DataFrame, model: Model, k: int) -> DataFrame:
    """Merge the packed k-grams, write their files, and return statistics, hot contexts' sums and the next order's grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _by_bucket(batches):
            keys, cols, counts = _summed(*_unpacked(rows, k, model.id_type))
            write_arrays(model.folder, f"grams-{k}-{bucket}", {"key": keys, "count": small(counts)})
            yield _packed(0, k, [*[int((counts == j).sum()) for j in (1, 2, 3, 4)], len(counts), int(counts.sum()), int((counts > 2).sum())], [])
            if k == 1:
                continue
            hot, context = model.hot_context(cols), _key(cols[:-1])
            _write_context(model, f"contexts-{k}-{bucket}", _contexts(context[~hot], counts[~hot]))
            sums = _contexts(context[hot], counts[hot])
            place = (mix64(sums["key"]) % np.uint64(model.buckets)).astype(np.int64)
            for b in np.unique(place):
                own = place == b
                yield _packed(1, int(b), [int(own.sum())], [v[own].view(np.int64) for v in sums.values()])
            _, next_cols, n = _summed(cols[1:], np.ones(len(counts), dtype=np.int64))
            yield from _dealt(model, next_cols, n)

    return grams.select("bucket", "stats", "data").repartition(model.buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, _PACKED)


def _merge_hot(rows: DataFrame, model: Model, k: int) -> None:
    """Add up the hot contexts' sums and write them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, group in _by_bucket(batches):
            parts = [np.frombuffer(r["data"], dtype=np.int64).reshape(5, -1) for r in group]
            keys, *sums = np.concatenate(parts, axis=1)
            order = np.argsort(keys.view(np.uint64), kind="stable")
            keys = keys.view(np.uint64)[order]
            at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            merged = [np.add.reduceat(x[order], at) for x in sums]
            _write_context(model, f"hot-{k}-{bucket}", dict(zip(["key", "total", "ones", "twos", "more"], [keys[at], *merged], strict=True)))
            yield pa.RecordBatch.from_pylist([{"bucket": bucket}])

    rows.select("bucket", "data").repartition(model.buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "bucket long").count()


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The three discounts from how many grams are counted 1 to 4 times."""
    if n1 and n2 and n3 and n4:
        y = n1 / (n1 + 2 * n2)
        out = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
        if all(0 <= d <= k for k, d in enumerate(out, 1)):
            return out
    return (0.5, 1.0, 1.5)


def fit(docs: DataFrame, p: KneserNey = KneserNey(), folder: str | None = None) -> Model:  # noqa: B008
    """Count the model of all given docs (text) and write its arrays to a folder (a URI; else one below the shared folder)."""
    folder = folder or scratch(docs.sparkSession, "lm")
    texts = docs.select("text")
    words = materialize(_count_words(texts, p), "words")
    found = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tokens, buckets = found[0], max(1, math.ceil(found[0] / p.bucket))
    files = sorted((r.first, r.size) for r in materialize(_write_words(words, folder), "files").collect())  # one row per 4 million words
    sizes = np.array([n for _, n in files], dtype=np.int64)
    model = Model(folder, p.order, buckets, tokens, found[1], np.array([f for f, _ in files], dtype=np.int64), np.cumsum(sizes) - sizes, np.empty(0))
    # a word above a bucket's share of all tokens: there are at most as many as buckets
    hot = np.sort(np.array([r.hash for r in words.where(F.col("n") > tokens / buckets).collect()], dtype=np.int64))
    model.hot = np.sort(model.word_ids(hot)[0])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for flat, sizes in _chunks(batches, p.chunk):
            seen, back = np.unique(flat, return_inverse=True)
            cols = _grams(model.word_ids(seen)[0][back], sizes, p.order, model.start)
            _, cols, n = _summed(cols, np.ones(len(flat), dtype=np.int64))
            yield from _dealt(model, cols, n)

    grams, levels = texts.mapInArrow(count, _PACKED), []
    for k in range(p.order, 0, -1):
        out = materialize(_merge(grams, model, k), f"order-{k}")
        stats = out.where("kind = 0").select(*[F.coalesce(F.sum(F.col("stats")[j]), F.lit(0)) for j in range(7)]).first()
        if k > 1:
            _merge_hot(out.where("kind = 1"), model, k)
        levels.append(Level(discounts(*stats[:4]), stats[5], stats[0], stats[1], stats[6]))
        grams = out.where("kind = 2")
    model.levels = levels[::-1]
    return model


def _gathered(model: Model, name: str, bucket: np.ndarray, keys: np.ndarray, fields: list[str]) -> list[np.ndarray]:
    """For sorted keys, fields of the files of their buckets; 0 where a key isn't there."""
    out = [np.zeros(len(keys), dtype=np.int64) for _ in fields]
    if not len(keys):
        return out
    order = np.argsort(bucket, kind="stable")
    used, cuts = np.unique(bucket[order], return_index=True)
    for b, low, high in zip(used, cuts, [*cuts[1:], len(order)], strict=True):
        own = mapped(model.folder, f"{name}-{b}")
        if own is not None:
            rows = order[low:high]
            at, there = find(own["key"], keys[rows])
            for x, f in zip(out, fields, strict=True):
                x[rows[there]] = own[f][at[there]]
    return out


def _distinct(cols: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    keys, first, back = np.unique(_key(cols), return_index=True, return_inverse=True)
    return keys, [c[first] for c in cols], back


def probabilities(model: Model, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The probability of each token after those before it in its text."""
    p = np.full(len(ids), 1 / (model.words + 1))
    for k, level in enumerate(model.levels, 1):
        cols = _grams(ids, sizes, k, model.start)
        keys, grams, back = _distinct(cols)
        count = _gathered(model, f"grams-{k}", model.place(grams), keys, ["count"])[0][back]
        if k == 1:
            total, ones, twos, more = (np.full(len(ids), x, dtype=np.int64) for x in (level.total, level.ones, level.twos, level.more))
        else:
            names = ["total", "ones", "twos", "more"]
            keys, contexts, back = _distinct(cols[:-1])
            hot = model.hot_context([*contexts, contexts[0]])
            bucket = (mix64(keys) % np.uint64(model.buckets)).astype(np.int64)
            sums = [np.zeros(len(keys), dtype=np.int64) for _ in names]
            for name, own in ((f"hot-{k}", hot), (f"contexts-{k}", ~hot)):
                for x, v in zip(sums, _gathered(model, name, bucket[own], keys[own], names), strict=True):
                    x[own] = v
            total, ones, twos, more = (x[back] for x in sums)
        d1, d2, d3 = level.discounts
        less = np.select([count == 0, count == 1, count == 2], [0.0, d1, d2], d3)
        with np.errstate(divide="ignore", invalid="ignore"):
            p = np.where(total > 0, (count - less + (d1 * ones + d2 * twos + d3 * more) * p) / total, p)
    return p


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of docs (doc_id, text).

    ``base_score`` is the add-one unigram's log10 probability, ``score`` the model's;
    perplexity is 10 to the power of -score / n_tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            flat, sizes = _tokens(batch)
            seen, back = np.unique(flat, return_inverse=True)
            ids, counts = model.word_ids(seen)
            ids, counts = ids[back], counts[back]
            base = np.log10((counts + 1) / (model.tokens + model.words + 1))
            full = np.log10(probabilities(model, ids, sizes))
            stops = np.cumsum(sizes)
            spans = list(zip(stops - sizes, stops, strict=True))
            known = np.add.reduceat(counts > 0, stops - sizes, dtype=np.int64) if len(sizes) else sizes
            columns = [sizes, known, *[np.array([math.fsum(x[a:b]) for a, b in spans]) for x in (base, full)]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, columns)], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    out = rows.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
