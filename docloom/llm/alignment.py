"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

A text's tokens end at byte offsets, in a sorted list for each tokenizer. The shorter
list drives a galloping search (exponential, then binary) into the longer; offsets in
both cut the tokens into groups, whose ranks in either list give the ranges of tokens
that overlap. All pairs of a group's tokens are linked.

The text is cut before each single space between two visible characters. Both
tokenizers begin a token there whatever stands around it (which their files must state:
byte-level pairs after the known pattern, and pieces in which a space only comes
first), so each segment is encoded and aligned once in a chunk of documents, many at a
time; a text's tokens are those of its segments. Segments at a text's ends that begin
or end otherwise are encoded apart from all others. If a segment isn't given back byte by byte, the whole text
is encoded and compared. Special tokens' strings are plain text.

Documents are worked on in chunks of a bounded size of text. A document's row keeps which of its chunk's
segments it holds; a file of arrays keeps which pairs the segments link, and a row how many of the chunk's
documents hold each pair. The sums over chunks are the corpus's counts; they are written
as sorted arrays, which workers map into memory to look up the chunks' pairs.

Null and empty texts have no tokens. Rows that repeat are documents of their own.
Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import math
import os
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.arrays import find, mapped, read_arrays, small, write_arrays
from docloom.llm.common import materialize, pieces, scratch, small_or_none, text_strings

#: A segment begins with a space between two characters that every reading of white space takes as visible.
_VISIBLE = r"[^\s\u0085\u180e\u200b-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff]"
_CUT = re.compile(rf" (?<={_VISIBLE} )(?={_VISIBLE})")  # a space that comes first is found fast
#: Segments of which both ends are such that any two of them, put together, have a cut in between.
_BOTH = re.compile(rf"{_VISIBLE}(?:.*{_VISIBLE})?", re.DOTALL)
_SPACE = "\u2581"
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
#: A pair's two ids as one number.
SHIFT = 32
#: So many characters of segments are encoded at once; a group of more links is long.
BATCH, LONG = 1 << 16, 4096


@dataclass(frozen=True)
class Alignment:
    """``bytes_file``: byte-level tokenizer, ``pieces_file``: model of pieces; a chunk ends with so many characters of text."""

    bytes_file: str
    pieces_file: str
    chunk: int = 8 << 20


def gallop(short: list[int], long: list[int]) -> tuple[list[int], list[int]]:
    """The places, in short and in long, of the numbers that two ascending lists share; each number of short is searched from where the last one was found."""
    low, size, ours, theirs = 0, len(long), [], []
    for i, x in enumerate(short):
        if low == size:
            break
        if long[low] < x:
            step = 1
            while low + step < size and long[low + step] < x:
                step *= 2
            low = bisect_left(long, x, low + step // 2 + 1, min(low + step, size))
            if low == size:
                break
        if long[low] == x:
            ours.append(i)
            theirs.append(low)
            low += 1
    return ours, theirs


def groups(a_ends: list[int], b_ends: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of either list end with each shared end: the ranks of the ends, which cut both lists into groups."""
    if len(a_ends) > len(b_ends):
        b, a = gallop(b_ends, a_ends)
    else:
        a, b = gallop(a_ends, b_ends)
    return np.array(a, dtype=np.int64) + 1, np.array(b, dtype=np.int64) + 1


@dataclass
class Aligned:
    """Segments' tokens: numbers of tokens, groups and links of each, its groups as text, and its links by pair."""

    totals: np.ndarray
    shown: list[str]
    segment: np.ndarray
    pair: np.ndarray
    times: np.ndarray


class Aligner:
    """Encodes and aligns texts, and segments many at a time."""

    def __init__(self, p: Alignment):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a batch of one text needs no threads
        self.a, self.b = Tokenizer.from_file(p.bytes_file), sentencepiece.SentencePieceProcessor(model_file=p.pieces_file)
        self.a.encode_special_tokens = True
        config, vocab = json.loads(self.a.to_str()), self.a.get_vocab()
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}  # the byte-level alphabet: these stand for themselves, others follow 255
        letters = {chr(k): k for k in shown} | {chr(256 + i): k for i, k in enumerate(k for k in range(256) if k not in shown)}
        self.a_bytes: list[bytes] = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            self.a_bytes[i] = bytes([letters[c] for c in t]) if all(c in letters for c in t) else t.encode()
        named = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(m[1], 16)]) if self.b.is_byte(i) and (m := _BYTE.fullmatch(t)) else t.replace(_SPACE, " ").encode() for i, t in enumerate(named)]
        # ids as a group shows them: A's before others and last, B's before others, last, and last of a segment
        self.names = np.array([f"{k}{mark}" for x, marks in ((self.a_bytes, ",|"), (self.b_bytes, [",", ";", ""])) for mark in marks for k in range(len(x))], dtype=object)
        self.a_sizes, self.b_sizes = (np.array([len(t) for t in x]) for x in (self.a_bytes, self.b_bytes))
        split = config["pre_tokenizer"] or {}
        known = config["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and config["model"]["type"] == "BPE"
        self.cuts = bool(known and not any(_SPACE in t.lstrip(_SPACE) for t in named))

    def segments(self, text: str) -> list[str]:
        """The parts of a text that are encoded by themselves, each with a space before it, which is left out here."""
        return _CUT.split(text) if self.cuts else [text]

    def aligned(self, segments: list[str], apart: bool = False) -> Aligned | None:
        """Align texts that begin with a space, encoded together, which cuts between them must allow, or apart; None if either tokenizer doesn't give their bytes back."""
        a, b = [], []
        for text in segments if apart else ["".join(segments)]:
            x, y, data = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.b.encode(text[1:]), text.encode()
            if b"".join([self.a_bytes[k] for k in x]) != data or b"".join([self.b_bytes[k] for k in y]) != data:
                return None
            a += x
            b += y
        a_ids, b_ids = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
        a_ends, b_ends = np.cumsum(self.a_sizes[a_ids]), np.cumsum(self.b_sizes[b_ids])
        a_stop, b_stop = groups(a_ends.tolist(), b_ends.tolist())
        last = np.searchsorted(a_ends[a_stop - 1], np.cumsum([len(x.encode()) for x in segments])) + 1  # groups up to each segment's end
        n_groups = np.diff(last, prepend=0)
        own = np.repeat(np.arange(len(segments)), n_groups)
        n_a, n_b = np.diff(a_stop, prepend=0), np.diff(b_stop, prepend=0)
        links = n_a * n_b
        totals = np.stack([np.diff(np.concatenate([[0], np.cumsum(x)])[last], prepend=0) for x in (n_a, n_b, np.ones_like(n_a), links)], axis=1)

        # each group's pairs, but for long groups, whose equal tokens are counted first
        size = np.where(links > LONG, 0, links)
        group = np.repeat(np.arange(len(size)), size)
        k = np.arange(len(group)) - np.repeat(np.cumsum(size) - size, size)
        pairs = [a_ids[(a_stop - n_a)[group] + k // n_b[group]] << SHIFT | b_ids[(b_stop - n_b)[group] + k % n_b[group]]]
        where, times = [own[group]], [np.ones(len(group), dtype=np.int64)]
        for g in np.flatnonzero(links > LONG):
            x, n = np.unique(a_ids[a_stop[g] - n_a[g] : a_stop[g]], return_counts=True)
            y, m = np.unique(b_ids[b_stop[g] - n_b[g] : b_stop[g]], return_counts=True)
            pairs.append((x[:, None] << SHIFT | y).reshape(-1))
            times.append((n[:, None] * m).reshape(-1))
            where.append(np.full(len(x) * len(y), own[g]))
        segment, pair, times = np.concatenate(where), np.concatenate(pairs), np.concatenate(times)

        # all groups' names in order, A's before B's
        n, m = len(self.a_bytes), len(self.b_bytes)
        a_ids[a_stop - 1] += n
        b_ids[b_stop - 1] += m
        b_ids[b_stop[last - 1] - 1] += m
        order = np.empty(len(a) + len(b), dtype=np.int64)
        order[np.arange(len(a)) + np.repeat(b_stop - n_b, n_a)] = a_ids
        order[np.arange(len(b)) + np.repeat(a_stop, n_b)] = b_ids + 2 * n
        names, cuts = self.names[order].tolist(), [0, *(a_stop + b_stop)[last - 1].tolist()]
        return Aligned(totals, ["".join(names[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)], segment, pair, times)


_ALIGNERS: dict[Alignment, Aligner] = {}


def aligner(p: Alignment) -> Aligner:
    """One aligner for each worker process."""
    if p not in _ALIGNERS:
        _ALIGNERS[p] = Aligner(p)
    return _ALIGNERS[p]


class _Chunk:
    """Some documents: of each, which segments it holds; of each segment, which pairs it links."""

    def __init__(self, own: Aligner):
        self.own = own
        #: segments' places; -1: not given back
        self.places: dict[str, int] = {}
        self.pairs: dict[int, int] = {}
        self.seg_pairs, self.seg_times, self.seg_sizes = [], [], []
        self.totals, self.shown = [], []
        self.doc_segs, self.doc_times, self.doc_sizes, self.docs = [], [], [], []
        self.held = np.zeros(0, dtype=np.int64)
        self.bytes = 0
        self.used = False

    def _keep(self, found: Aligned) -> int:
        """Take segments in; the place of the first."""
        pairs, first = self.pairs, len(self.shown)
        known, back = np.unique(found.pair, return_inverse=True)
        ids = np.array([pairs.setdefault(x, len(pairs)) for x in known.tolist()], dtype=np.int64)
        each, back = np.unique(found.segment << SHIFT | ids[back], return_inverse=True)
        self.seg_pairs.append((each & ((1 << SHIFT) - 1)).astype(np.int32))
        self.seg_times.append(np.bincount(back, found.times, len(each)).astype(np.int64))
        self.seg_sizes.append(np.bincount(each >> SHIFT, minlength=len(found.shown)).astype(np.int32))
        self.totals.append(found.totals)
        self.shown += found.shown
        return first

    def _learn(self, segments: list[str], apart: bool = False) -> None:
        """Align segments that are new here, many at a time, encoded together or apart; if one isn't given back, one by one."""
        batch, size = [], 0
        for k, x in enumerate(segments, 1):
            batch.append(x)
            size += len(x)
            if size >= BATCH or k == len(segments):
                if found := self.own.aligned([" " + y for y in batch], apart):
                    self.places.update(zip(batch, range(first := self._keep(found), first + len(batch)), strict=True))
                else:
                    for y in batch:
                        one = self.own.aligned([" " + y])
                        self.places[y] = self._keep(one) if one else -1
                batch, size = [], 0

    def add(self, ids: list[int | None], texts: list[str]) -> None:
        """Some documents' segments; none of a document whose bytes aren't given back."""
        split = [self.own.segments(x) if x else [] for x in texts]
        new = [x for x in dict.fromkeys(chain.from_iterable(split)) if x not in self.places]
        # white space at a text's ends would run into the next segment's space; whole texts aren't cut at all
        apart = {x for own in split if own for x in (own[0], own[-1]) if not (self.own.cuts and _BOTH.fullmatch(x))}
        self._learn([x for x in new if x not in apart])
        self._learn([x for x in new if x in apart], apart=True)
        places, shown, whole = self.places, self.shown, []
        for segments, text in zip(split, texts, strict=True):
            at = list(map(places.__getitem__, segments))
            if -1 in at:  # the parts aren't given back: the whole text might be
                found = self.own.aligned([" " + text])
                at = [self._keep(found)] if found else []
            whole.append(at)
        for parts in (self.seg_pairs, self.seg_times, self.seg_sizes, self.totals):
            parts[:] = [np.concatenate(parts)] if parts else []
        totals, sizes, pairs = (x[0] if x else np.empty(0, dtype=np.int64) for x in (self.totals, self.seg_sizes, self.seg_pairs))
        starts = np.cumsum(sizes, dtype=np.int64) - sizes
        self.held = np.concatenate([self.held, np.zeros(len(self.pairs) - len(self.held), dtype=np.int64)])
        for doc_id, text, at in zip(ids, texts, whole, strict=True):
            where, times = np.unique(np.array(at, dtype=np.int64), return_counts=True)
            digest = hashlib.sha256(";".join(map(shown.__getitem__, at)).encode()).hexdigest() if len(at) else ""
            self.docs.append((doc_id, *(times @ totals[where] if len(where) else np.zeros(4, dtype=np.int64)).tolist(), digest))
            self.doc_segs.append(where.astype(np.int32))
            self.doc_times.append(times.astype(np.int32))
            self.doc_sizes.append(len(where))
            own = sizes[where].astype(np.int64)
            every = np.repeat(starts[where] - np.cumsum(own) + own, own) + np.arange(own.sum())
            self.held[np.unique(pairs[every])] += 1
            self.bytes += len(text)
            self.used = True

    def write(self, folder: str, name: str) -> None:
        """Which pairs each segment links, for workers to map when all pairs are counted."""
        sizes, pairs, times = (x[0] if x else np.empty(0, dtype=np.int32) for x in (self.seg_sizes, self.seg_pairs, self.seg_times))
        write_arrays(folder, name, {"sizes": small(sizes), "pairs": small(pairs), "times": small(times), "pair": np.fromiter(self.pairs, dtype=np.int64, count=len(self.pairs))})

    def take(self) -> pa.RecordBatch:
        """The documents since the last time."""
        columns = [pa.array(x, t) for x, (_, t) in zip(zip(*self.docs, strict=True), _DOC, strict=True)]
        offsets = pa.array(np.concatenate([[0], np.cumsum(self.doc_sizes)]), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x), pa.int32())) for x in (self.doc_segs, self.doc_times)]
        n = len(self.docs)
        self.docs, self.doc_segs, self.doc_times, self.doc_sizes = [], [], [], []
        return _rows(n, dict(zip([k for k, _ in _DOC], columns, strict=True)) | dict(zip(["segs", "times"], lists, strict=True)))

    def counted(self) -> pa.RecordBatch:
        """A row of the chunk's pairs and how many of its documents hold each."""
        return _rows(1, {"pairs": _one(np.fromiter(self.pairs, dtype=np.int64, count=len(self.pairs))), "held": _one(self.held)})


_DOC = [("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())]
#: Rows of documents (their chunk, and which segments of it they hold, how often), and of chunks (their pairs).
_TYPES = [("chunk", pa.string()), *_DOC, ("segs", pa.list_(pa.int32())), ("times", pa.list_(pa.int32())), ("pairs", pa.list_(pa.int64())), ("held", pa.list_(pa.int64()))]
_CHUNK = "chunk string, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, segs array<int>, times array<int>, pairs array<long>, held array<long>"


def _one(values: np.ndarray) -> pa.Array:
    """A column of one row, a list."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, pa.int64()))


def _rows(n: int, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """Rows with nulls in the other columns."""
    return pa.RecordBatch.from_arrays([columns.get(k, pa.nulls(n, t)) for k, t in _TYPES], [k for k, _ in _TYPES])


def chunks(docs: DataFrame, p: Alignment, folder: str) -> DataFrame:
    """Align docs (doc_id, text): rows of documents and rows of chunks; chunks' segments go to files in a folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, seq = aligner(p), TaskContext.get().partitionId(), 0
        chunk = _Chunk(own)
        named = lambda rows, name: rows.set_column(0, "chunk", pa.array([name] * rows.num_rows, pa.string()))
        for batch in pieces(batches):
            if batch.num_rows:
                chunk.add(batch.column(0).to_pylist(), text_strings(batch))
                yield named(chunk.take(), name := f"chunk-{part}-{seq}")
            if chunk.bytes >= p.chunk:
                chunk.write(folder, name)
                yield chunk.counted()
                chunk, seq = _Chunk(own), seq + 1
        if chunk.used:
            chunk.write(folder, f"chunk-{part}-{seq}")
            yield chunk.counted()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _CHUNK)


def pair_counts(parts: DataFrame) -> DataFrame:
    """(pair, n, best): how many documents hold each pair, from chunks' pairs (pair, held), if any does, and whether no other of its first id is held by more."""
    counts = materialize(parts.where("held > 0").groupBy("pair").agg(F.sum("held").alias("n")), "pairs")
    first = F.shiftright("pair", SHIFT)
    most = counts.groupBy(first.alias("_a")).agg(F.max("n").alias("_most"))  # one row for each id of a vocabulary
    return counts.join(small_or_none(materialize(most, "most"), 1_000_000), first == F.col("_a")).select("pair", "n", (F.col("n") == F.col("_most")).alias("best"))


def _write_counts(counts: DataFrame, folder: str) -> list[int]:
    """Write the pairs in order, a few million a file, for workers to map; the least pair of each file."""
    n = max(1, math.ceil(counts.count() / 4_000_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = pa.Table.from_batches(list(batches), schema=pa.schema([("pair", pa.int64()), ("n", pa.int64()), ("best", pa.bool_())]))
        if found.num_rows:  # the range of one file
            first = found["pair"][0].as_py()
            write_arrays(folder, f"pairs-{first}", {"pair": found["pair"].to_numpy(), "n": found["n"].to_numpy(), "best": found["best"].to_numpy().astype(np.uint8)})
            yield pa.RecordBatch.from_pylist([{"first": first}])

    files = counts.select("pair", "n", "best").repartitionByRange(n, "pair").sortWithinPartitions("pair").mapInArrow(run, "first long")
    return sorted(r.first for r in materialize(files, "files").collect())  # one row for each file


def _found(folder: str, firsts: list[int], pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each pair, how many documents hold it and whether it is its first id's best; 0 if none does."""
    n, best = np.zeros(len(pairs), dtype=np.int64), np.zeros(len(pairs), dtype=np.int64)
    order = np.argsort(pairs, kind="stable")
    wanted = pairs[order]
    cuts = np.append(np.searchsorted(wanted, firsts), len(wanted))
    for k, first in enumerate(firsts):
        rows = order[cuts[k] : cuts[k + 1]]
        if len(rows):
            own = mapped(folder, f"pairs-{first}")
            at, there = find(own["pair"], pairs[rows])
            n[rows[there]], best[rows[there]] = own["n"][at[there]], own["best"][at[there]]
    return n, best


def align(docs: DataFrame, p: Alignment) -> tuple[DataFrame, DataFrame]:
    """Align docs (doc_id, text) and count linked pairs over all of them.

    Returns (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each document, and
    the corpus's pairs (a, b, n, best).
    """
    folder = scratch(docs.sparkSession, "alignment")
    made = materialize(chunks(docs, p, folder), "chunks")
    parts = made.where("pairs IS NOT NULL").select(F.explode(F.arrays_zip("pairs", "held")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.held").alias("held"))
    counts = materialize(pair_counts(parts), "counts")
    firsts = _write_counts(counts, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, values = None, ()
        for batch in pieces(batches):
            chunk = batch.column("chunk").to_pylist()
            at = [0, *[k for k in range(1, len(chunk)) if chunk[k] != chunk[k - 1]], len(chunk)]
            for low, high in zip(at, at[1:], strict=False):
                if low == high:
                    continue
                if chunk[low] != now:  # documents of one chunk stand together
                    now, values = chunk[low], _values(folder, chunk[low], firsts)
                own = batch.slice(low, high - low)
                segs, times = (own.column(c).flatten().to_numpy() for c in ("segs", "times"))
                sizes = pc.list_value_length(own.column("segs")).to_numpy()
                totals = [pa.array(_sums(v[segs] * times, sizes)) for v in values]
                yield pa.RecordBatch.from_arrays([*[own.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")], *totals, own.column("groups_sha256")], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    ready = made.where("chunk IS NOT NULL").drop("pairs", "held")
    out = ready.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return out, counts.select(F.shiftright("pair", SHIFT).alias("a"), F.col("pair").bitwiseAND((1 << SHIFT) - 1).alias("b"), "n", "best")


def _values(folder: str, chunk: str, firsts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Of each of a chunk's segments, how many of its links are best, and the sum of its links' counts."""
    own = read_arrays(folder, chunk)
    n, best = _found(folder, firsts, own["pair"])
    sizes, times = own["sizes"].astype(np.int64), own["times"].astype(np.int64)
    return tuple(_sums(v[own["pairs"]] * times, sizes) for v in (best, n))


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of stretches of the given sizes."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    stops = np.cumsum(sizes, dtype=np.int64)
    return total[stops] - total[stops - sizes]
