"""Vectorised word and shingle hashing over UTF-8 bytes, used inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_MASK = (1 << 64) - 1
#: Bytes of a text that are hashed at once.
BLOCK = 1 << 17


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def random_u64(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values for a seed, alike on every machine."""
    step = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix64(step + np.uint64(seed * 0xD1342543DE82EF95 & _MASK))


class WordHasher:
    """Hashes the words of a text; a word is a maximal run of bytes for which ``is_word`` holds.

    A word's hash is a polynomial over random byte values modulo 2**64, mixed
    once more. Long texts are cut between words into blocks of about ``BLOCK``
    bytes, so that memory stays in proportion to the block (or the longest word)
    and to the number of words.
    """

    def __init__(self, is_word: np.ndarray, lower: bool = True, seed: int = 7):
        table = np.arange(256, dtype=np.uint8)
        if lower:
            table[65:91] += 32
        self.is_word = is_word[table] & is_word
        self.values = random_u64(seed, 256)[table] | np.uint64(1)
        self.base = int(random_u64(seed + 1, 1)[0]) | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self._up = np.ones(1, dtype=np.uint64)
        self._down = np.ones(1, dtype=np.uint64)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self._up) < n:
            k = len(self._up)
            self._up = np.concatenate([self._up, self._up * np.uint64(pow(self.base, k, 1 << 64))])
            self._down = np.concatenate([self._down, self._down * np.uint64(pow(self.inverse, k, 1 << 64))])
        return self._up, self._down

    def words(self, data: bytes) -> np.ndarray:
        """The hash of each word, in order."""
        return self.prefixes(data, [None])[0]

    def prefixes(self, data: bytes, lengths: list[int | None]) -> list[np.ndarray]:
        """For each length, the hash of each word's first so many bytes (None: the whole word)."""
        b = np.frombuffer(data, dtype=np.uint8)
        blocks = [self._block(b[k:stop], lengths) for k, stop in self._cuts(b)]
        return blocks[0] if len(blocks) == 1 else [np.concatenate(x) for x in zip(*blocks, strict=True)]

    def _cuts(self, b: np.ndarray) -> Iterator[tuple[int, int]]:
        start = 0
        while len(b) - start > BLOCK:
            stop = start + BLOCK
            while stop < len(b) and self.is_word[b[stop]]:
                stop += 1
            yield start, stop
            start = stop
        yield start, len(b)

    def _block(self, b: np.ndarray, lengths: list[int | None]) -> list[np.ndarray]:
        if not len(b):
            return [np.empty(0, dtype=np.uint64) for _ in lengths]
        inside = np.zeros(len(b) + 2, dtype=np.int8)
        inside[1:-1] = self.is_word[b]
        edge = np.diff(inside)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        up, down = self._powers(len(b) + 1)
        total = np.empty(len(b) + 1, dtype=np.uint64)
        total[0] = 0
        np.cumsum(self.values[b] * up[: len(b)], out=total[1:])
        out = []
        for length in lengths:
            stop = end if length is None else np.minimum(end, start + length)
            out.append(mix64((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64)))
        return out


def word_bytes(separators: list[tuple[int, int]]) -> np.ndarray:
    """A table of 256 flags that is false for the given inclusive byte ranges."""
    table = np.ones(256, dtype=bool)
    for low, high in separators:
        table[low : high + 1] = False
    return table


#: Words between ASCII white space.
SPACED = word_bytes([(0x20, 0x20), (0x09, 0x0D)])
#: Words of ASCII digits, ASCII letters and everything beyond ASCII.
ALNUM = word_bytes([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
ALNUM[65:91] = True  # they are lower-cased first


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``width`` words; one of all words if there are fewer; none without words."""
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    out = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n] + np.uint64(k + 1))
    return np.unique(out)
