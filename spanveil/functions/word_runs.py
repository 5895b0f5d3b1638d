"""Words of many texts at once, as arrays: places and hashes of runs of words.

All work is on code points, so places are offsets in the text. A word is a run
of letters, marks, digits and underscores; a run of words has nothing but white
space between them. Hashes are 64-bit polynomials over folded code points: texts
that are equal in lower case have equal hashes, in every process. The other way
round does not hold for sure, so a hit has to be compared as text.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import regex

# A word is a run of these; hyphens and apostrophes separate words.
WORD_CLASS = r"\p{L}\p{M}\p{N}_"

# Odd multipliers of the polynomials (any odd number serves).
CHAR_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD1342543DE82EF95
# Characters whose hash is worked out at a time.
CHUNK = 1 << 18
DOT_ABOVE, CAPITAL_I_DOT = 0x307, 0x130
SIGMA, FINAL_SIGMA = 0x3C3, 0x3C2


@lru_cache(1)
def _ranges() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of word characters, those of white space, and pairs of a character and its lower case.

    Lower case depends on the place for sigma, and is two characters long for
    the capital i with a dot: the hash folds both sigmas into one and drops the
    dot, so that equal words stay equal.
    """
    every = "".join(map(chr, range(sys.maxunicode + 1)))
    words = np.array([m.span() for m in regex.finditer(f"[{WORD_CLASS}]+", every)])
    spaces = np.array([m.span() for m in regex.finditer(r"\s+", every) if m.group().isspace()])
    lower = [(ord(c), ord(c.lower()[0])) for c in every if c.lower() != c]
    return words, spaces, np.array([*lower, (FINAL_SIGMA, SIGMA)])


def character_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a task needs to make its tables; a few thousand numbers."""
    return _ranges()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n + 1, base, dtype=np.uint64)
    down = np.full(n + 1, pow(base, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


class _Polynomial:
    """Hashes of runs of numbers, from prefix sums."""

    def __init__(self, base: int) -> None:
        self.base = base
        self.up, self.down = _powers(base, 1 << 12)

    def of(self, values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        if len(values) >= len(self.up):
            self.up, self.down = _powers(self.base, 2 * len(values))
        sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * self.up[: len(values)], out=sums[1:])
        return mix((sums[end] - sums[begin]) * self.down[begin] + (end - begin).astype(np.uint64))


@dataclass
class Words:
    """Words of a batch of texts, in order. Places are offsets within their text."""

    text: np.ndarray  # number of the text
    start: np.ndarray
    end: np.ndarray
    hashes: np.ndarray
    # joined[i]: nothing but white space lies between word i and the next one of the text
    joined: np.ndarray


class WordRuns:
    """Splits texts and hashes runs of their words; made once per task."""

    def __init__(self, words: np.ndarray, spaces: np.ndarray, lower: np.ndarray) -> None:
        size = sys.maxunicode + 1
        self.is_word = np.zeros(size, dtype=bool)
        for a, b in words:
            self.is_word[a:b] = True
        self.is_other = ~self.is_word
        for a, b in spaces:
            self.is_other[a:b] = False
        self.fold = np.arange(size, dtype=np.uint32)
        self.fold[lower[:, 0]] = lower[:, 1]
        self.chars, self.runs = _Polynomial(CHAR_BASE), _Polynomial(WORD_BASE)

    def words(self, texts: Sequence[str]) -> Words:
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        word = self.is_word[points]
        # A text's first character begins a word whatever stands before it, in another text.
        edge = np.zeros(len(points) + 1, dtype=bool)
        edge[bounds] = True
        begins = word.copy()
        begins[1:] &= ~word[:-1] | edge[1:-1]
        ends = word.copy()
        ends[:-1] &= ~word[1:] | edge[1:-1]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        number = np.searchsorted(bounds, start, "right") - 1
        hashes = np.empty(len(start), dtype=np.uint64)
        first = 0
        while first < len(start):
            last = max(first + 1, int(np.searchsorted(end, start[first] + CHUNK, "right")))
            low, high = int(start[first]), int(end[last - 1])
            hashes[first:last] = self._hashes(points[low:high], start[first:last] - low, end[first:last] - low)
            first = last
        joined = np.zeros(len(start), dtype=bool)
        if len(start) > 1:
            others = np.zeros(len(points) + 1, dtype=np.int32)
            np.cumsum(self.is_other[points], out=others[1:])
            joined[:-1] = (number[1:] == number[:-1]) & (others[end[:-1]] == others[start[1:]])
        return Words(number, start - bounds[number], end - bounds[number], hashes, joined)

    def _hashes(self, points: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        if (points == DOT_ABOVE).any():
            kept = points != DOT_ABOVE
            before = np.concatenate([[0], np.cumsum(kept)])
            points, begin, end = points[kept], before[begin], before[end]
        values = mix((self.fold[points].astype(np.uint64) + np.uint64(1)) * np.uint64(CHAR_BASE))
        return self.chars.of(values, begin, end)

    def of_lengths(self, words: Words, lengths: Sequence[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each length, the numbers of the first and the last word of the runs, and the runs' hashes."""
        breaks = np.concatenate([[0], np.cumsum(~words.joined)])
        for n in lengths:
            first = np.arange(max(len(words.hashes) - n + 1, 0))
            first = first[breaks[first + n - 1] == breaks[first]]
            yield first, first + n - 1, self.runs.of(words.hashes, first, first + n)

    def term_hashes(self, keys: Sequence[str]) -> np.ndarray:
        """Hashes of whole terms: words with one space between them."""
        words = self.words(keys)
        bounds = np.searchsorted(words.text, np.arange(len(keys) + 1))
        return self.runs.of(words.hashes, bounds[:-1], bounds[1:])
