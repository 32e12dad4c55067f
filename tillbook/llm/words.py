"""Words and their hashes from the bytes of many texts at once, without a Python loop over words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

# Texts handled together, in bytes; bounds a worker's arrays.
CHUNK_BYTES = 1 << 18

# Sums modulo 2**64 are equal for some long sequences that differ, whatever the base; words of so many bytes have a digest.
LONG_WORD = 256

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_SHIFT = (np.uint64(30), np.uint64(27), np.uint64(31))


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers after which all bits depend on all bits."""
    values = values.astype(np.uint64, copy=True)
    values ^= values >> _SHIFT[0]
    values *= _MIX[0]
    values ^= values >> _SHIFT[1]
    values *= _MIX[1]
    values ^= values >> _SHIFT[2]
    return values


@lru_cache(maxsize=4)
def _powers(length: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below length; base is odd."""
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.full(length, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


class Rolling:
    """Fingerprints of any slice of a sequence of numbers, from running sums modulo 2**64."""

    def __init__(self, values: np.ndarray):
        size = 1 << max(10, int(len(values)).bit_length())
        up, self.down = _powers(size, int(_BASE))
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def rough(self, length: int) -> np.ndarray:
        """Of every slice of one length, numbers whose high bits are good enough to compare."""
        return (self.sums[length:] - self.sums[: max(0, len(self.sums) - length)]) * self.down[: max(0, len(self.sums) - length)]

    def at(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return mix((self.sums[start + length] - self.sums[start]) * self.down[start])


@lru_cache(maxsize=1)
def byte_numbers() -> np.ndarray:
    """A fixed 64-bit number for each byte."""
    return mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts end to end, and the offsets between them; null counts as empty."""
    binary = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(binary.buffers()[1], np.int64)[binary.offset : binary.offset + len(binary) + 1]
    data = binary.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(sizes: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[slice]:
    """Runs of rows of about ``limit`` bytes; a larger row is a run of its own."""
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield slice(start, i)
            start, total = i, 0
        total += int(size)
    if start < len(sizes):
        yield slice(start, len(sizes))


def word_spans(raw: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every maximal run of word bytes within one text, and the text's number."""
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = is_word[raw]
    change = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = change[::2], change[1::2]
    # a run that reaches over the end of a text is cut there
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(raw))]
    inner = np.unique(inner)
    cut = inner[inside[inner] & inside[inner + 1]] if len(inner) else inner
    if len(cut):
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def not_space() -> np.ndarray:
    """Bytes of words: all but space and tab to carriage return."""
    table = np.ones(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = False
    return table


def letters() -> np.ndarray:
    """Bytes of words without punctuation: digits, letters, and all bytes of other characters."""
    table = np.zeros(256, bool)
    for first, last in (("0", "9"), ("a", "z"), ("A", "Z")):
        table[ord(first) : ord(last) + 1] = True
    table[0x80:] = True
    return table


def word_hashes(raw: np.ndarray, rolling: Rolling, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words of ``raw``, whose bytes ``rolling`` has."""
    hashes = rolling.at(starts, ends - starts)
    for i in np.flatnonzero(ends - starts >= LONG_WORD):
        hashes[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return hashes


class Words:
    """All words of a run of texts: spans in bytes, text numbers, and 64-bit hashes."""

    def __init__(self, texts: pa.Array, is_word: np.ndarray, lower: bool = False):
        self.raw, self.offsets = text_bytes(texts)
        folded = self.raw
        if lower:
            table = np.arange(256, dtype=np.uint8)
            table[ord("A") : ord("Z") + 1] += 32
            folded = table[self.raw]
        self.starts, self.ends, self.text = word_spans(folded, self.offsets, is_word)
        self.lengths = self.ends - self.starts
        self.rolling = Rolling(byte_numbers()[folded])
        self.hashes = word_hashes(folded, self.rolling, self.starts, self.ends)
        # where each text's words begin
        self.first = np.searchsorted(self.text, np.arange(len(self.offsets)))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text number, first word, hash) of every run of ``size`` words; a shorter text is one run of all its words."""
        n = len(self.hashes)
        rolling = Rolling(self.hashes)
        at = np.arange(max(0, n - size + 1))
        at = at[self.text[at] == self.text[at + size - 1]] if len(at) else at
        counts = self.counts()
        short = np.flatnonzero((counts > 0) & (counts < size))
        begin = np.concatenate([at, self.first[short]])
        length = np.concatenate([np.full(len(at), size), counts[short]])
        order = np.argsort(begin, kind="stable")
        begin, length = begin[order], length[order]
        return self.text[begin], begin, rolling.at(begin, length)
