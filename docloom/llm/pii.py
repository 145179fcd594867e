"""Personal data: base patterns, and a character-level BiLSTM with CRF transitions.

The network is trained in numpy on labelled spans of a bounded sample of
documents: those of the base patterns, and variants of them that no base pattern
matches (see ``variant``), each in its own surroundings. A text is read wherever
a span can lie: every kind holds a digit, an at-sign or a spelled-out dot, so the
zones within ``margin`` characters of one are cut into overlapping windows, each
is decoded, and every character takes its tag from the window in which it lies
farthest from the edge. Spans of the network that meet the kind's own conditions
and touch no base span are added to the base spans.

Nulls and empties: a null or empty text has no spans. A null doc_id is kept.
Repeated rows are repeated. Without labelled spans only the base spans are
found. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import per_batch, text_strings

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[int, int, str, int]


def luhn(digits: str) -> bool:
    """Whether the digits pass Luhn's check."""
    total = sum(int(d) for d in digits[-1::-2])
    return (total + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])) % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> list[Span]:
    """From each at-sign to the left over local characters, not beyond the match before."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        m, start = (_DOMAIN.match(text, at), at) if at >= free else (None, at)
        if m:
            while start > free and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                free = m.end()
                out.append((start, 0, "email", free))
        at = text.find("@", at + 1)
    return out


def _numbers(text: str) -> list[Span]:
    out: list[Span] = []
    for m in _DOTTED.finditer(text):
        if m.group().count(".") >= 3:
            parts, at = m.group().split("."), m.start()
            for k in range(0, len(parts) - 3, 4):
                four = parts[k : k + 4]
                stop = at + sum(map(len, four)) + 3
                if all(len(x.lstrip("0")) <= 3 and int(x[-3:]) <= 255 for x in four):
                    out.append((at, 1, "ip", stop))
                at = stop + 1
    for m in _CARD.finditer(text):
        d = digits_of(m.group())
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, "card", m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(digits_of(m.group())) <= 15:
                out.append((m.start(), 3, "phone", m.end()))
    return out


_DIGIT = re.compile(r"[0-9]")


def base_spans(text: str) -> list[Span]:
    """(start, rank, kind, stop) of the base patterns, by start, then kind."""
    found = _emails(text) if "@" in text else []
    if _DIGIT.search(text):
        found += _numbers(text)
    return sorted(found)


@dataclass(frozen=True)
class Pii:
    #: Documents that the training sees at most; they are chosen by a hash of doc_id.
    sample: int = 6000
    #: Windows that the training sees at most.
    windows: int = 6000
    #: Variants of each labelled span.
    variants: int = 4
    margin: int = 32
    window: int = 64
    overlap: int = 24
    embed: int = 10
    hidden: int = 14
    steps: int = 400
    batch: int = 48
    rate: float = 0.02
    seed: int = 5


#: Characters by class: ASCII as they are, then letters, white space and the rest beyond it.
CLASSES = 131
TAGS = 1 + 2 * len(KINDS)
#: Spelled-out marks of an address, in the languages at hand. Fixed values.
_AT, _DOT = ("at", "arroba", "chez", "bei"), ("dot", "punkt", "point", "punto")
_TRIGGER = re.compile(r"[0-9@]+|(?<![^\W_])(?:" + "|".join(_DOT) + r")(?![^\W_])", re.I)
_AT_MARK = re.compile(r"@|(?<![^\W_])(?:" + "|".join(_AT) + r")(?![^\W_])", re.I)
_DOT_MARK = re.compile(r"\.|(?<![^\W_])(?:" + "|".join(_DOT) + r")(?![^\W_])", re.I)


def variant(kind: str, own: str, rng: random.Random) -> str:
    """Another way to write a span.

    Addresses: at and dots spelled out, in brackets or between blanks. IPs: other
    separators. Cards: other separators and groups. Phones: without plus, with 00
    for it, with other separators and brackets, with other digits.
    """
    if kind == "email":
        name, host = own.split("@")
        hold = rng.choice(["{}", " {} ", "({})", "[{}]", " ({}) ", " [{}] "])
        word = lambda marks, plain: hold.format(rng.choice(marks) if hold != "{}" else plain)
        return name + (word(_AT, "@") if rng.random() < 0.8 else " @ ") + word(_DOT, ".").join(host.split("."))
    d = digits_of(own)
    if kind == "ip":
        return rng.choice(["[.]", "(.)", " . ", "-", ",", "_", ". "]).join(re.findall("[0-9]+", own))
    if kind == "card":
        size = rng.choice([4, 4, 4, 6, 5])
        return rng.choice([".", "/", "_", "  ", " - ", "--", ":"]).join(d[k : k + size] for k in range(0, len(d), size))
    d = d[0] + "".join(rng.choice("0123456789") for _ in d[1:])
    head, rest = d[: max(1, len(d) - 10)], d[max(1, len(d) - 10) :]
    cut = [rest[:3], rest[3:6], rest[6:]]
    gap = rng.choice(["-", " ", ".", "/", " - "])
    first = rng.choice(["{}", "({})", "[{}]", "({})"]).format(cut[0])
    return rng.choice([f"{head}{gap}", f"00{head}{gap}", f"00 {head} ", f"+ {head}{gap}", f"+{head}/", ""]) + gap.join([first, *cut[1:]])


def codes(text: str) -> np.ndarray:
    """The class of each character."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    out = np.minimum(points, 128).astype(np.int16)
    for k in np.flatnonzero(points >= 128):
        c = text[k]
        out[k] = 128 if c.isalpha() else 129 if c.isspace() else 130
    return out


def zones(text: str, margin: int) -> list[tuple[int, int]]:
    """Merged zones within margin of a digit, an at-sign or a spelled-out dot."""
    out: list[tuple[int, int]] = []
    for m in _TRIGGER.finditer(text):
        start, stop = max(0, m.start() - margin), min(len(text), m.end() + margin)
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], stop)
        else:
            out.append((start, stop))
    return out


def cut(zone: tuple[int, int], p: Pii) -> list[tuple[int, int]]:
    """Overlapping windows over a zone."""
    start, stop = zone
    step = p.window - p.overlap
    return [(a, min(a + p.window, stop)) for a in range(start, max(start + 1, stop - p.overlap), step)]


class Tagger:
    """A bidirectional LSTM with a linear-chain CRF on top; parameters are plain arrays."""

    def __init__(self, p: Pii, weights: dict[str, np.ndarray] | None = None):
        self.p = p
        rng, h, e = np.random.default_rng(p.seed), p.hidden, p.embed
        scale = lambda *shape: (rng.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
        bias = np.zeros(4 * h, dtype=np.float32)
        bias[h : 2 * h] = 1.0
        self.w = weights or {"E": scale(CLASSES, e) * 3, "Wf": scale(e + h, 4 * h), "bf": bias, "Wb": scale(e + h, 4 * h), "bb": bias.copy(), "O": scale(2 * h, TAGS), "o": np.zeros(TAGS, dtype=np.float32), "A": np.zeros((TAGS + 1, TAGS), dtype=np.float32)}

    def _lstm(self, x: np.ndarray, name: str, keep: list | None) -> np.ndarray:
        """x (time, batch, embed) to hidden states (time, batch, hidden)."""
        h_, w, b = self.p.hidden, self.w["W" + name], self.w["b" + name]
        steps, n, e = x.shape
        pre = x.reshape(-1, e) @ w[:e] + b
        pre = pre.reshape(steps, n, -1)
        h = c = np.zeros((n, h_), dtype=np.float32)
        out = np.empty((steps, n, h_), dtype=np.float32)
        for t in range(steps):
            z = pre[t] + h @ w[e:]
            gates = 1 / (1 + np.exp(-z[:, : 3 * h_]))
            i, f, o = gates[:, :h_], gates[:, h_ : 2 * h_], gates[:, 2 * h_ :]
            g = np.tanh(z[:, 3 * h_ :])
            before = c
            c = f * c + i * g
            tc = np.tanh(c)
            if keep is not None:
                keep.append((h, before, i, f, o, g, tc))
            h = o * tc
            out[t] = h
        return out

    def _lstm_back(self, x: np.ndarray, name: str, keep: list, dh_all: np.ndarray, grad: dict) -> np.ndarray:
        h_, w = self.p.hidden, self.w["W" + name]
        steps, n, e = x.shape
        dw, dz_all = np.zeros_like(w), np.empty((steps, n, 4 * h_), dtype=np.float32)
        dh = dc = np.zeros((n, h_), dtype=np.float32)
        for t in range(steps - 1, -1, -1):
            h, before, i, f, o, g, tc = keep[t]
            dh = dh + dh_all[t]
            do, dc = dh * tc, dc + dh * o * (1 - tc**2)
            dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), do * o * (1 - o), dc * i * (1 - g**2)], axis=1)
            dz_all[t] = dz
            dw[e:] += h.T @ dz
            dc, dh = dc * f, dz @ w[e:].T
        flat = dz_all.reshape(-1, 4 * h_)
        dw[:e] = x.reshape(-1, e).T @ flat
        grad["W" + name], grad["b" + name] = dw, flat.sum(axis=0)
        return (flat @ w[:e].T).reshape(x.shape)

    def emissions(self, codes_: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Tag scores (time, batch, tags) of classes (time, batch)."""
        x = self.w["E"][codes_]
        states = ([], []) if keep is not None else (None, None)
        hf, hb = self._lstm(x, "f", states[0]), self._lstm(x[::-1], "b", states[1])[::-1]
        h = np.concatenate([hf, hb], axis=2)
        if keep is not None:
            keep |= {"x": x, "states": states, "h": h}
        return h @ self.w["O"] + self.w["o"]

    def loss_grad(self, codes_: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Negative log-likelihood of the tags by the CRF, and its gradient."""
        keep: dict = {}
        s = self.emissions(codes_, keep)
        a, first = self.w["A"][:TAGS], self.w["A"][TAGS]
        steps, n, _ = s.shape
        alpha, beta = np.empty_like(s), np.zeros_like(s)
        alpha[0] = first + s[0]
        for t in range(1, steps):
            alpha[t] = _logsum(alpha[t - 1][:, :, None] + a, 1) + s[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = _logsum(a + (s[t + 1] + beta[t + 1])[:, None, :], 2)
        z = _logsum(alpha[-1], 1)
        marginal = np.exp(alpha + beta - z[None, :, None])
        one = np.eye(TAGS, dtype=np.float32)[tags]
        grad = {"A": np.zeros_like(self.w["A"])}
        for t in range(1, steps):
            pair = np.exp(alpha[t - 1][:, :, None] + a + (s[t] + beta[t])[:, None, :] - z[:, None, None])
            grad["A"][:TAGS] += (pair.sum(axis=0) - one[t - 1].T @ one[t]) / n
        grad["A"][TAGS] = (marginal[0] - one[0]).mean(axis=0)
        gold = (s * one).sum(axis=(0, 2)) + first[tags[0]] + a[tags[:-1], tags[1:]].sum(axis=0)
        ds = (marginal - one) / n
        flat_h, flat_d = keep["h"].reshape(-1, 2 * self.p.hidden), ds.reshape(-1, TAGS)
        grad["O"], grad["o"] = flat_h.T @ flat_d, flat_d.sum(axis=0)
        dh = (flat_d @ self.w["O"].T).reshape(keep["h"].shape)
        h_ = self.p.hidden
        dx = self._lstm_back(keep["x"], "f", keep["states"][0], dh[:, :, :h_], grad)
        dx = dx + self._lstm_back(keep["x"][::-1], "b", keep["states"][1], dh[::-1, :, h_:], grad)[::-1]
        grad["E"] = np.zeros_like(self.w["E"])
        np.add.at(grad["E"], codes_.reshape(-1), dx.reshape(-1, self.p.embed))
        return float((z - gold).mean()), grad

    def train(self, codes_: np.ndarray, tags: np.ndarray) -> list[float]:
        """Adam over random batches of windows (windows x time); returns the losses."""
        p, rng, losses = self.p, np.random.default_rng(self.p.seed + 1), []
        m, v = ({k: np.zeros_like(x) for k, x in self.w.items()} for _ in range(2))
        for step in range(1, p.steps + 1):
            at = rng.integers(0, len(codes_), p.batch)
            loss, grad = self.loss_grad(codes_[at].T, tags[at].T)
            rate = p.rate * min(1, step / 20) * (1 - step / (p.steps + 1))
            norm = np.sqrt(sum(float((g**2).sum()) for g in grad.values()))
            for k, g in grad.items():
                g = g * min(1, 5 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.w[k] = self.w[k] - (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
            losses.append(loss)
        return losses

    def decode(self, codes_: np.ndarray) -> np.ndarray:
        """The best tags (time, batch)."""
        s = self.emissions(codes_)
        a = self.w["A"][:TAGS]
        best = self.w["A"][TAGS] + s[0]
        back = np.empty(s.shape, dtype=np.int8)
        for t in range(1, len(s)):
            all_ = best[:, :, None] + a
            back[t] = all_.argmax(axis=1)
            best = np.take_along_axis(all_, back[t][:, None, :].astype(np.int64), 1)[:, 0] + s[t]
        out = np.empty(s.shape[:2], dtype=np.int8)
        out[-1] = best.argmax(axis=1)
        rows = np.arange(s.shape[1])
        for t in range(len(s) - 1, 0, -1):
            out[t - 1] = back[t][rows, out[t]]
        return out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def tags_of(length: int, spans: list[Span]) -> np.ndarray:
    """Begin and inside tags of each character."""
    out = np.zeros(length, dtype=np.int8)
    for start, rank, _, stop in spans:
        if not out[start:stop].any():
            out[start] = 1 + 2 * rank
            out[start + 1 : stop] = 2 + 2 * rank
    return out


def spans_of(tags: np.ndarray, offset: int) -> list[Span]:
    """The spans that a run of tags spells."""
    out: list[Span] = []
    edge = np.flatnonzero(np.concatenate([[True], tags[1:] != tags[:-1], [True]]))
    start, kind = -1, -1
    for a in edge.tolist():
        tag = int(tags[a]) if a < len(tags) else 0
        rank = (tag - 1) // 2 if tag else -1
        if start >= 0 and (rank != kind or tag % 2 == 1):
            out.append((offset + start, kind, KINDS[kind], offset + a))
            start = -1
        if tag and start < 0:
            start, kind = a, rank
    return out


def trimmed(text: str, span: Span) -> Span:
    """A span without white space at its ends; an address with the whole words that it begins and ends in."""
    start, rank, kind, stop = span
    while start < stop and text[start].isspace():
        start += 1
    while start < stop and text[stop - 1].isspace():
        stop -= 1
    if kind == "email":
        while start > 0 and text[start - 1] in _LOCAL:
            start -= 1
        while stop < len(text) and text[stop - 1].isalnum() and text[stop].isalnum():
            stop += 1
    return start, rank, kind, stop


def plausible(text: str, span: Span) -> bool:
    """The conditions that a kind sets whatever its form."""
    own = text[span[0] : span[3]]
    d = digits_of(own)
    if not own or "\n" in own or text[max(0, span[0] - 1) : span[0]].isalnum() or text[span[3] : span[3] + 1].isalnum():
        return False
    if span[2] == "email":
        parts = _AT_MARK.split(own)
        return len(parts) == 2 and bool(parts[0].strip(" ([")) and len([x for x in _DOT_MARK.split(parts[1].strip(" )].")) if x.strip(" ()[]")]) >= 2
    if span[2] == "ip":
        parts = re.findall(r"[0-9]+", own)
        return len(parts) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in parts) and not any(c.isalpha() for c in own)
    if span[2] == "card":
        return 12 <= len(d) <= 19 and luhn(d) and not any(c.isalpha() for c in own)
    return 9 <= len(d) <= 15 and own[0] in "+([0123456789" and not any(c.isalpha() for c in own)


def model_spans(texts: list[str], tagger: Tagger) -> list[list[Span]]:
    """The network's spans of each text; zones of all texts are decoded together."""
    p, places = tagger.p, []
    for k, text in enumerate(texts):
        for zone in zones(text, p.margin) if _TRIGGER.search(text) else []:
            places.append((k, zone, cut(zone, p)))
    out: list[list[Span]] = [[] for _ in texts]
    todo = [(n, a, b) for n, (_, _, windows) in enumerate(places) for a, b in windows]
    tags = [np.zeros(stop - start, dtype=np.int8) for _, (start, stop), _ in places]
    depth = [np.full(stop - start, -1, dtype=np.int16) for _, (start, stop), _ in places]
    for k in range(0, len(todo), 1024):
        part = todo[k : k + 1024]
        grid = np.full((p.window, len(part)), 32, dtype=np.int16)
        for j, (n, a, b) in enumerate(part):
            grid[: b - a, j] = codes(texts[places[n][0]][a:b])
        found = tagger.decode(grid)
        for j, (n, a, b) in enumerate(part):
            start, size = places[n][1][0], b - a
            inner = np.minimum(np.arange(size), size - 1 - np.arange(size)).astype(np.int16)
            if a == places[n][1][0]:
                inner[: size // 2] = p.window
            if b == places[n][1][1]:
                inner[size // 2 :] = p.window
            here = slice(a - start, b - start)
            better = inner > depth[n][here]
            tags[n][here][better] = found[:size, j][better]
            depth[n][here][better] = inner[better]
    for (k, (start, _), _), t in zip(places, tags, strict=True):
        if t.any():
            out[k] += [s for s in (trimmed(texts[k], s) for s in spans_of(t, start)) if plausible(texts[k], s)]
    return out


def labelled(text: str, p: Pii) -> list[tuple[str, list[Span]]]:
    """A text with its base spans, and pieces of it in which one of them is written another way."""
    spans = base_spans(text)
    out, rng = [(text, spans)], random.Random(zlib.crc32(text.encode("utf-8", "surrogatepass")))
    for start, rank, kind, stop in spans:
        for _ in range(p.variants):
            left, right = text[max(0, start - p.window) : start], text[stop : stop + p.window]
            if rng.random() < 0.25:  # right before another number
                right = " " + "".join(rng.choice("0123456789.") for _ in range(rng.randint(2, 12))) + right
            own = variant(kind, text[start:stop], rng) if rng.random() < 0.85 else text[start:stop]
            after = len(left) + len(own)
            around = base_spans(left) + [(a + after, r, k, b + after) for a, r, k, b in base_spans(right)]
            out.append((left + own + right, [(len(left), rank, kind, after), *around]))
    return out


def training_windows(docs: DataFrame, p: Pii) -> DataFrame:
    """(order, codes, tags) of windows in zones of the sampled documents and of the variants."""
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")  # at most p.sample rows

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        order, xs, ys = [], [], []
        for whole in text_strings(batch, "text"):
            for text, spans in labelled(whole, p):
                tags = tags_of(len(text), spans)
                for zone in zones(text, p.margin):
                    for a, b in cut(zone, p):
                        x, y = np.full(p.window, 32, dtype=np.int16), np.zeros(p.window, dtype=np.int8)
                        x[: b - a], y[: b - a] = codes(text[a:b]), tags[a:b]
                        order.append(hashlib.md5(text[a:b].encode("utf-8", "replace")).hexdigest())
                        xs.append(x.tobytes())
                        ys.append(y.tobytes())
        return pa.RecordBatch.from_arrays([pa.array(order, pa.string()), pa.array(xs, pa.binary()), pa.array(ys, pa.binary())], ["order", "codes", "tags"])

    return per_batch(rows, run, "order string, codes binary, tags binary").distinct().orderBy("order", "tags").limit(p.windows)


def trained(docs: DataFrame, p: Pii = Pii()) -> Tagger | None:
    """The network, or None without labelled spans."""
    rows = training_windows(docs, p).toArrow().sort_by("order")
    if not rows.num_rows:
        return None
    x = np.frombuffer(b"".join(rows["codes"].to_pylist()), dtype=np.int16).reshape(-1, p.window)
    y = np.frombuffer(b"".join(rows["tags"].to_pylist()), dtype=np.int8).reshape(-1, p.window)
    if not y.any():
        return None
    tagger = Tagger(p)
    tagger.train(x, y)
    return tagger


def find_personal_data(docs: DataFrame, tagger: Tagger | None, p: Pii = Pii()) -> DataFrame:
    """(doc_id, base, spans) of each row of docs (doc_id, text), each an array of (start, rank, kind, stop) in that order."""
    weights = docs.sparkSession.sparkContext.broadcast(tagger.w) if tagger else None
    kind = pa.list_(pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("kind", pa.string()), ("stop", pa.int64())]))
    names = ("start", "rank", "kind", "stop")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = text_strings(batch)
        base = [base_spans(x) for x in texts]
        added = model_spans(texts, Tagger(p, weights.value)) if weights else [[] for _ in texts]
        both = [sorted(b + [s for s in m if not any(s[0] < t[3] and t[0] < s[3] for t in b)]) for b, m in zip(base, added, strict=True)]
        columns = [pa.array([[dict(zip(names, s, strict=True)) for s in row] for row in rows], kind) for rows in (base, both)]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "base", "spans"])

    span = "array<struct<start:long,rank:int,kind:string,stop:long>>"
    return per_batch(docs.select(F.col("doc_id").cast("long"), "text"), run, f"doc_id long, base {span}, spans {span}")
