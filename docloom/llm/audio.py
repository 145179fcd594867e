"""Media columns: 8-bit audio and its features.

``encode`` stores a payload of bytes losslessly as a WAV file of unsigned 8-bit
mono samples; ``decode`` reads it. ``features`` resamples the samples with a
polyphase filter, takes overlapped frames to log-mel filterbanks and cuts the
sound into segments by energy with hysteresis. A clip's filterbanks are Arrow
tensors of one fixed shape, ``patch`` frames by ``mels`` bands, each with its
time span; the last one is padded with silence.

Nulls and empties: a null or empty text is a payload of 64 zero bytes. Equal
payloads have equal media and features. Repeated rows are repeated clips.
Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import materialize, per_batch, text_bytes

BLOCK = 64


@dataclass(frozen=True)
class Audio:
    rate: int = 8000
    to_rate: int = 6000
    frame: int = 256
    hop: int = 128
    mels: int = 16
    patch: int = 16
    #: Taps of the resampling filter on each side of its centre, in samples of the slower rate.
    reach: int = 6
    #: A segment begins above ``on`` and ends below ``off`` decibels (of full scale).
    on: float = -8.0
    off: float = -12.0


def pad(data: bytes) -> bytes:
    """The bytes with zeros up to a positive multiple of BLOCK."""
    return data + bytes(max(BLOCK, -(-len(data) // BLOCK) * BLOCK) - len(data))


def encode(payload: bytes, rate: int) -> bytes:
    """A WAV file (RIFF, PCM, one channel, unsigned 8 bits)."""
    head = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    odd = b"\0" * (len(payload) % 2)
    data = struct.pack("<4sI", b"data", len(payload)) + payload + odd
    return struct.pack("<4sI4s", b"RIFF", 4 + len(head) + len(data), b"WAVE") + head + data


def decode(media: bytes) -> tuple[bytes, int]:
    """Samples and rate of a WAV file as written by ``encode``."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("no WAV file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("not one channel of 8-bit samples")
        elif name == b"data":
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no samples")


def phases(rate: int, to_rate: int, reach: int) -> tuple[int, int, np.ndarray]:
    """Up and down factors, and the windowed sinc's taps by phase (up x taps)."""
    up, down = to_rate // gcd(rate, to_rate), rate // gcd(rate, to_rate)
    half = reach * max(up, down)
    t = np.arange(-half, half + 1)
    h = np.sinc(t / max(up, down)) * np.hanning(len(t)) * up / max(up, down)
    taps = -(-len(h) // up)
    table = np.zeros((up, taps))
    for p in range(up):
        own = h[p::up]
        table[p, : len(own)] = own[::-1] if len(own) == taps else np.concatenate([own[::-1]])
        if len(own) < taps:
            table[p] = np.concatenate([np.zeros(taps - len(own)), own[::-1]])
    return up, down, table


def resample(x: np.ndarray, up: int, down: int, table: np.ndarray, reach: int) -> np.ndarray:
    """x at up / down times its rate: each output is one phase's taps over its neighbours."""
    taps, half = table.shape[1], reach * max(up, down)
    n = -(-len(x) * up // down)
    y = np.empty(n)
    # output m takes h[p + up * k] * x[c - k] with m * down + half = up * c + p
    padded = np.concatenate([np.zeros(taps), x, np.zeros(taps + half)])
    views = np.lib.stride_tricks.sliding_window_view(padded, taps)
    for r in range(min(up, n)):
        c, p = divmod(r * down + half, up)
        first = c - taps + 1 + taps
        count = len(range(r, n, up))
        y[r::up] = views[first : first + (count - 1) * down + 1 : down] @ table[p]
    return y


def mel_bank(p: Audio) -> np.ndarray:
    """Triangular filters (bins x mels), evenly spaced on the mel scale."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(p.to_rate / 2), p.mels + 2) / 2595) - 1)
    bins = np.fft.rfftfreq(p.frame, 1 / p.to_rate)[:, None]
    rise, fall = (bins - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - bins) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall))


def hysteresis(level: np.ndarray, on: float, off: float) -> list[tuple[int, int]]:
    """Runs of frames (start, stop) that begin at a level of at least on and last until it is under off."""
    mark = np.where(level >= on, 1, np.where(level < off, 0, -1))
    last = np.maximum.accumulate(np.where(mark >= 0, np.arange(len(mark)), -1))
    state = np.where(last >= 0, mark[np.maximum(last, 0)], 0)
    edge = np.diff(np.concatenate([[0], state, [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


class Analyser:
    """Features of one clip at a time, so that they depend on nothing else."""

    def __init__(self, p: Audio):
        self.p, self.bank, self.window = p, mel_bank(p), np.hanning(p.frame)
        self.up, self.down, self.table = phases(p.rate, p.to_rate, p.reach)

    def __call__(self, samples: bytes) -> tuple[np.ndarray, list[tuple[float, float]], list[tuple[float, float]]]:
        """Tensors (patches x patch x mels), their spans and the segments, in seconds."""
        p = self.p
        x = (np.frombuffer(samples, dtype=np.uint8).astype(float) - 128) / 128
        y = resample(x, self.up, self.down, self.table, p.reach)
        n = max(1, -(-max(0, len(y) - p.frame) // p.hop) + 1)
        y = np.concatenate([y, np.zeros((n - 1) * p.hop + p.frame - len(y))]) if len(y) < (n - 1) * p.hop + p.frame else y
        frames = np.lib.stride_tricks.sliding_window_view(y, p.frame)[:: p.hop][:n]
        mel, level = np.empty((n, p.mels), dtype=np.float32), np.empty(n)
        for k in range(0, n, 2048):
            part = frames[k : k + 2048]
            power = np.abs(np.fft.rfft(part * self.window)) ** 2
            mel[k : k + 2048] = np.log(power @ self.bank + 1e-6)
            level[k : k + 2048] = 10 * np.log10((part**2).mean(axis=1) + 1e-9)
        count, second = -(-n // p.patch), p.hop / p.to_rate
        tensors = np.full((count * p.patch, p.mels), np.float32(np.log(1e-6)), dtype=np.float32)
        tensors[:n] = mel
        spans = [(k * p.patch * second, min((k + 1) * p.patch, n) * second) for k in range(count)]
        return tensors.reshape(count, p.patch, p.mels), spans, [(a * second, b * second) for a, b in hysteresis(level, p.on, p.off)]


def tensor_bytes(tensors: np.ndarray, spans: list[tuple[float, float]]) -> bytes:
    """An Arrow stream with a fixed-shape tensor column and its spans' starts and stops."""
    column = pa.FixedShapeTensorArray.from_numpy_ndarray(np.ascontiguousarray(tensors))
    start, stop = (pa.array([s[k] for s in spans], pa.float64()) for k in (0, 1))
    batch = pa.RecordBatch.from_arrays([column, start, stop], ["mel", "start_s", "stop_s"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def store(docs: DataFrame, p: Audio = Audio()) -> DataFrame:
    """Write (doc_id, n_bytes, payload_bytes, media) of docs (doc_id, text) and return the stored table."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = text_bytes(batch)
        payloads = [pad(x) for x in texts]
        columns = [batch.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array([len(x) for x in payloads], pa.int64()), pa.array([encode(x, p.rate) for x in payloads], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "payload_bytes", "media"])

    return materialize(per_batch(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_bytes long, payload_bytes long, media binary"), "media")


def features(clips: DataFrame, p: Audio = Audio()) -> DataFrame:
    """Add payload_sha256, tail_crc32, tensors (an Arrow stream) and segments to a stored table of clips."""
    analyse, carried = Analyser(p), ["doc_id", "n_bytes", "payload_bytes", "media_bytes", "media_sha256"]
    segment = pa.list_(pa.struct([("start_s", pa.float64()), ("stop_s", pa.float64())]))
    rows = clips.select("doc_id", "n_bytes", "payload_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sums, tails, tensors, segments = [], [], [], []
        for media in batch.column(len(carried)).to_pylist():
            samples, _ = decode(media)
            mel, spans, found = analyse(samples)
            sums.append(hashlib.sha256(samples).hexdigest())
            tails.append(zlib.crc32(samples[-BLOCK:]))
            tensors.append(tensor_bytes(mel, spans))
            segments.append([{"start_s": a, "stop_s": b} for a, b in found])
        own = [pa.array(sums, pa.string()), pa.array(tails, pa.int64()), pa.array(tensors, pa.binary()), pa.array(segments, segment)]
        return pa.RecordBatch.from_arrays([batch.column(k) for k in range(len(carried))] + own, [*carried, "payload_sha256", "tail_crc32", "tensors", "segments"])

    return per_batch(rows, run, "doc_id long, n_bytes long, payload_bytes long, media_bytes long, media_sha256 string, payload_sha256 string, tail_crc32 long, tensors binary, segments array<struct<start_s:double,stop_s:double>>")
