"""Token ids as flat binary shards.

A shard is two files: ``NAME.bin`` holds the ids of its documents, one after the
other, as little-endian unsigned integers and nothing else; ``NAME.idx`` holds a
header (magic, width of an id, number of documents), the documents' offsets into
the ids as 64-bit integers (one more than documents), their doc_ids as 64-bit
integers and a byte each that is 1 for a null doc_id. Shards hold ascending
ranges of doc_id, nulls first; a shard's base is the prefix sum over the shards
before it. Rows of one doc_id may fill several shards.

Texts are encoded whole. Null and empty texts have the end id only. Rows that
repeat a doc_id stand next to each other, by a hash of their text. Further columns are
ignored. A shard is written under another name and renamed when complete, so a
repeated or lost task leaves nothing half-written.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import materialize, pieces, scratch, text_bytes

MAGIC = b"TOKSHARD"
_HEADER = struct.Struct("<8sQQ")


@dataclass(frozen=True)
class Tokens:
    """``remember``: so many words and pieces of words are kept with their ids in a worker process, where the tokenizer treats words one by one."""

    tokenizer: str
    end_id: int = 1
    remember: int = 1_000_000


#: A tokenizer of this kind lower-cases, drops white space and looks at nothing beyond it. Fixed values.
_WORDWISE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: Words of which that normaliser changes nothing but case, one letter to one, and that hold no special token.
_PLAIN = re.compile(r"[!-;=-~À-ÖØ-öø-ÿ]+")
#: That pattern, for such words in lower case.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


class _Remembered(dict):
    """A function's values by argument; it forgets all of them when they are too many."""

    def __init__(self, function: Callable, most: int):
        self.function, self.most = function, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self.function(key)
        if len(key) < 200:
            self[key] = value
        return value


class Encoder:
    """Encodes whole texts to the bytes of their ids.

    Under a tokenizer of the known kind, which its file must state, words between
    ASCII white space are encoded once each and remembered: a plain word is cut
    into pieces, and the tokenizer's own model encodes each piece. Other words,
    and all texts under other tokenizers, go through the whole tokenizer.
    """

    def __init__(self, t: Tokens):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(t.tokenizer)
        vocab, config = self.tokenizer.get_vocab(), json.loads(self.tokenizer.to_str())
        self.dtype = np.dtype("<u2" if max([t.end_id, *vocab.values()]) < 1 << 16 else "<u4")
        self.end = np.array([t.end_id], dtype=self.dtype).tobytes()
        marks = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.wordwise = all(config[k] == v for k, v in _WORDWISE.items()) and config["model"]["type"] == "BPE" and all(m.startswith("<") and not set(m) & set(" \t\n\r\v\f") for m in marks)
        if self.wordwise:
            from tokenizers.pre_tokenizers import ByteLevel

            letters = ByteLevel(add_prefix_space=False, use_regex=False)
            self.model, self.shown = self.tokenizer.model, {k: letters.pre_tokenize_str(chr(k))[0][0] for k in range(0xC0, 0x100)}
            self.one = [np.array([k], dtype=self.dtype).tobytes() for k in range(max(vocab.values()) + 1)]
            self.known = _Remembered(self._word, t.remember)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def _merged(self, piece: str) -> bytes:
        one = self.one
        return b"".join([one[x.id] for x in self.model.tokenize(piece)])

    def _word(self, data: bytes) -> bytes:
        word = data.decode()
        if data.isalpha() and data.islower():  # these are ASCII letters
            return self._merged(word)
        if not _PLAIN.fullmatch(word):
            return self._whole(word)
        pieces = _PIECES.findall(word.lower())
        return self._merged(word if word.isascii() else word.translate(self.shown)) if pieces == [word] else b"".join([self.known[x.encode()] for x in pieces])

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of each text (UTF-8) with the end id."""
        for data in texts:
            yield (b"".join(map(self.known.__getitem__, data.split())) if self.wordwise else self._whole(data.decode())) + self.end


_ENCODERS: dict[Tokens, Encoder] = {}


def encoder(t: Tokens) -> Encoder:
    """One encoder for each worker process."""
    if t not in _ENCODERS:
        _ENCODERS[t] = Encoder(t)
    return _ENCODERS[t]


def _rename(fs: pafs.FileSystem, old: str, new: str) -> None:
    if fs.get_file_info(new).type != pafs.FileType.NotFound:
        fs.delete_file(new)
    fs.move(old, new)


def _index(width: int, offsets: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> bytes:
    return _HEADER.pack(MAGIC, width, len(ids)) + offsets.tobytes() + ids.astype("<i8").tobytes() + nulls.tobytes()


def write_shards(docs: DataFrame, t: Tokens, folder: str | None = None, shards: int | None = None) -> DataFrame:
    """Write docs (doc_id, text) and return the manifest: (shard, n_docs, n_tokens, base), one row per shard.

    ``shards``: how many; without it, Spark's shuffle partitions, which adaptive
    execution may merge.
    """
    folder = folder or scratch(docs.sparkSession, "tokens")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = [F.col("doc_id"), F.xxhash64("text")]  # the rows of one id, or of none, may be many
    rows = (rows.repartitionByRange(shards, *order) if shards else rows.repartitionByRange(*order)).sortWithinPartitions(*order, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shard = encoder(t), f"part-{TaskContext.get().partitionId():06d}"
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        draft = f"{root}/.{shard}-{uuid.uuid4().hex}"
        lengths, ids, nulls = [], [], []
        with fs.open_output_stream(draft + ".bin") as out:
            for batch in pieces(batches):
                column = batch.column(0)
                ids.append(np.asarray(column.fill_null(0), dtype="<i8"))
                nulls.append(np.asarray(column.is_null()).astype(np.uint8))
                for data in own.encode(text_bytes(batch)):
                    lengths.append(len(data) // own.dtype.itemsize)
                    out.write(data)
        offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]).astype("<i8")
        if not lengths:
            fs.delete_file(draft + ".bin")
            return
        with fs.open_output_stream(draft + ".idx") as out:
            out.write(_index(own.dtype.itemsize, offsets, np.concatenate(ids), np.concatenate(nulls)))
        for end in (".bin", ".idx"):
            _rename(fs, draft + end, f"{root}/{shard}{end}")
        yield pa.RecordBatch.from_pylist([{"shard": f"{folder}/{shard}", "n_docs": len(lengths), "n_tokens": int(offsets[-1])}])

    manifest = materialize(rows.mapInArrow(run, "shard string, n_docs long, n_tokens long"), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


class Shard:
    """A shard's files, mapped into memory where they are local files."""

    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        with fs.open_input_file(path + ".idx") as f:
            data = f.read()
        magic, width, n = _HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError(f"{uri}.idx is no index of token ids")
        at = _HEADER.size
        self.offsets = np.frombuffer(data, dtype="<i8", count=n + 1, offset=at)
        self.doc_ids = np.frombuffer(data, dtype="<i8", count=n, offset=at + 8 * (n + 1))
        self.nulls = np.frombuffer(data, dtype=np.uint8, count=n, offset=at + 8 * (2 * n + 1))
        self.dtype = np.dtype(f"<u{width}")
        self.file = pa.memory_map(path + ".bin") if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path + ".bin")

    def __len__(self) -> int:
        return len(self.doc_ids)

    def ids(self, k: int) -> np.ndarray:
        """The ids of document k."""
        width = self.dtype.itemsize
        start, stop = int(self.offsets[k]) * width, int(self.offsets[k + 1]) * width
        return np.frombuffer(self.file.read_at(stop - start, start), dtype=self.dtype)


def read_shards(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, read from the shards' files."""
    n = max(1, manifest.count())
    places = manifest.select("shard", "base").repartition(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row["shard"])
                for k in range(0, len(shard), 8192):
                    part = range(k, min(k + 8192, len(shard)))
                    crc = [zlib.crc32(shard.ids(j).astype("<u4").tobytes()) for j in part]
                    at = shard.offsets[k : part.stop + 1]
                    ids = pa.array(shard.doc_ids[k : part.stop], mask=shard.nulls[k : part.stop].astype(bool))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(at[:-1] + row["base"]), pa.array(np.diff(at)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return places.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
