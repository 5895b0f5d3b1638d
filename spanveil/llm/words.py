"""Words of many texts at once, as arrays: places, hashes, hashes of runs.

All work is on UTF-8 bytes. A word is a maximal run of word bytes; its hash is
a 64-bit polynomial over mixed byte values, so equal words have equal hashes in
every process, and the hash of any run of words follows from prefix sums.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# Odd multipliers of the polynomials (any odd number serves).
BYTE_BASE = 0x9E3779B97F4A7C15
RUN_BASE = 0xD1342543DE82EF95
# Texts are cut into pieces of about so many bytes, between words.
PIECE = 1 << 18


def not_space() -> np.ndarray:
    """Word bytes of ``[^\\x20\\x09-\\x0D]+``."""
    table = np.ones(256, dtype=bool)
    table[[0x20, *range(0x09, 0x0E)]] = False
    return table


def letters_digits() -> np.ndarray:
    """Word bytes of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``."""
    table = np.zeros(256, dtype=bool)
    table[0x30:0x3A] = table[0x61:0x7B] = table[0x80:] = True
    return table


def not_newline() -> np.ndarray:
    """Bytes of lines that are not blank."""
    table = np.ones(256, dtype=bool)
    table[0x0A] = False
    return table


def lower_az() -> np.ndarray:
    """Byte table that folds A-Z."""
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 32
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n."""
    up = np.full(n + 1, base, dtype=np.uint64)
    down = np.full(n + 1, pow(base, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


@dataclass
class Words:
    """Words of a batch of texts. ``bounds[r]:bounds[r+1]`` are those of row r."""

    hashes: np.ndarray
    begins: np.ndarray  # first byte, in ``data``
    ends: np.ndarray  # behind the last byte
    bounds: np.ndarray
    data: np.ndarray  # folded bytes of all texts


class Splitter:
    """Splits texts into words by a table of word bytes, after folding bytes."""

    def __init__(self, word_bytes: np.ndarray, fold: np.ndarray | None = None) -> None:
        self.word_bytes = word_bytes
        self.fold = fold
        values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BYTE_BASE))
        self.values = values | np.uint64(1)
        self.up, self.down = powers(BYTE_BASE, PIECE)

    def _grow(self, n: int) -> None:
        if n >= len(self.up):
            self.up, self.down = powers(BYTE_BASE, 2 * n)

    def split(self, texts: pa.Array) -> Words:
        """``texts``: an Arrow string array without nulls."""
        texts = texts.cast(pa.large_string())
        count = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + count + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        if self.fold is not None:
            data = self.fold[data]
        word = self.word_bytes[data]
        before = np.empty(len(data), dtype=bool)
        after = np.empty(len(data), dtype=bool)
        if len(data):
            before[0] = after[-1] = False
            before[1:], after[:-1] = word[:-1], word[1:]
            filled = offsets[:-1][offsets[1:] > offsets[:-1]]
            before[filled] = False
            after[filled[1:] - 1] = False
        begins = np.flatnonzero(word & ~before)
        ends = np.flatnonzero(word & ~after) + 1
        hashes = np.empty(len(begins), dtype=np.uint64)
        first = 0
        while first < len(begins):
            last = max(first + 1, int(np.searchsorted(ends, begins[first] + PIECE, "right")))
            low, high = int(begins[first]), int(ends[last - 1])
            self._grow(high - low)
            sums = np.zeros(high - low + 1, dtype=np.uint64)
            np.cumsum(self.values[data[low:high]] * self.up[: high - low], out=sums[1:])
            b, e = begins[first:last] - low, ends[first:last] - low
            hashes[first:last] = mix((sums[e] - sums[b]) * self.down[b] + (e - b).astype(np.uint64))
            first = last
        return Words(hashes, begins, ends, np.searchsorted(begins, offsets), data)


class Runs:
    """Hashes of runs of consecutive items, from the items' hashes."""

    def __init__(self) -> None:
        self.up, self.down = powers(RUN_BASE, 1 << 16)

    def sums(self, hashes: np.ndarray) -> np.ndarray:
        if len(hashes) >= len(self.up):
            self.up, self.down = powers(RUN_BASE, 2 * len(hashes))
        sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
        np.cumsum(hashes * self.up[: len(hashes)], out=sums[1:])
        return sums

    def between(self, sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of items begin..end-1, for arrays of places."""
        return mix((sums[end] - sums[begin]) * self.down[begin] + (end - begin).astype(np.uint64))

    def grams(self, hashes: np.ndarray, k: int) -> np.ndarray:
        """Hashes of all runs of k items; none if there are fewer items."""
        if len(hashes) < k:
            return np.zeros(0, dtype=np.uint64)
        sums = self.sums(hashes)
        begin = np.arange(len(hashes) - k + 1)
        return self.between(sums, begin, begin + k)


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Places that hold the least value of some ``width`` consecutive ones; of equal ones the last.

    Every run of ``width`` values holds such a place, and equal runs hold it at
    the same offset, wherever they stand.
    """
    if len(values) < width:
        return np.zeros(0, dtype=np.int64)
    runs = np.lib.stride_tricks.sliding_window_view(values[::-1], width)
    return np.unique(len(values) - 1 - (np.arange(len(runs)) + runs.argmin(axis=1)))


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n items lie in one of the spans; spans are clipped to the items."""
    edges = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edges, np.clip(starts, 0, n), 1)
    np.add.at(edges, np.clip(np.maximum(ends, starts), 0, n), -1)
    return np.cumsum(edges[:-1]) > 0
