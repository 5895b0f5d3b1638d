"""Byte pair encoding for tokenizer files of the word-end kind.

A file names the vocabulary, the merges in rank order, the special tokens, a
normalizer (NFC, lower case) and the pattern of pre-tokens. Texts are split at
special tokens first, then normalized and split into pre-tokens; each pre-token
is spelt in byte letters, its last letter carries the word end, and merges are
applied lowest rank first.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import regex

# Longest word, in parts, that is merged by scanning its rank array.
SHORT = 64
# Words that a task keeps the result of; the store is emptied when it is full.
STORE = 200_000
NO_RANK = 1 << 60


# The pre-token pattern and the normalizer of the files that are supported.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
# The pattern for ASCII texts, put in lower case.
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\s\x1c-\x1fa-z0-9]+|[\x1c-\x1f]+"


# Letters and digits that Unicode 16 added, which the library's pattern knows and Python's tables of 15.1 do not.
LATER_LETTERS = (
    (0x1C8A, 0x1C8A), (0xA7CD, 0xA7CD), (0xA7DB, 0xA7DB), (0x105C0, 0x105F3), (0x10D4A, 0x10D4F), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7),
    (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C),
    (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9),
    (0x1E5F1, 0x1E5FA),
)
# Capitals of later versions that the library puts in lower case.
LATER_CAPITALS = {
    0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B,
    **{c: c + 0x20 for c in range(0x10D50, 0x10D66)}, **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)},
}


def newer_letters() -> str:
    """A class body of the code points that the pattern module takes for letters or numbers and the library does not.

    These are the ones that Unicode 15.1, whose tables Python has here, has not assigned, less those of LATER_LETTERS.
    """
    every = "".join(map(chr, range(sys.maxunicode + 1)))
    known = {c for a, b in LATER_LETTERS for c in range(a, b + 1)} | set(LATER_CAPITALS)
    found = [ord(m.group()) for m in regex.finditer(r"[\p{L}\p{N}]", every) if unicodedata.category(m.group()) == "Cn"]
    ranges: list[list[int]] = []
    for point in found:
        if point in known:
            continue
        if ranges and point == ranges[-1][1] + 1:
            ranges[-1][1] = point
        else:
            ranges.append([point, point])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable, else one from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = [""] * 256
    for b in printable:
        letters[b] = chr(b)
    others = [b for b in range(256) if not letters[b]]
    for i, b in enumerate(others):
        letters[b] = chr(0x100 + i)
    return letters


def lower(text: str) -> str:
    """Lower case of each character by itself: a final capital sigma is no exception."""
    if "Σ" in text:
        return "σ".join(part.lower() for part in text.split("Σ"))
    return text.lower()


class Tokenizer:
    """Encodes and decodes; made once per task from the bytes of the file and what `newer_letters` gives."""

    def __init__(self, file: bytes, newer: str | None = None) -> None:
        spec = json.loads(file)
        model = spec["model"]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        rules = (model["type"], spec["normalizer"]["normalizers"], split["type"], split["pattern"], spec["decoder"])
        if rules != ("BPE", NORMALIZERS, "Split", {"Regex": PATTERN}, None):
            raise ValueError("only word-end BPE files with NFC, lower case and the known pattern are supported")
        self.end = model["end_of_word_suffix"]
        self.vocabulary: dict[str, int] = model["vocab"]
        self.ranks = {(a, b): i for i, (a, b) in enumerate(map(tuple, model["merges"]))}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.words_of = regex.compile(PATTERN).findall
        self.ascii_words_of = regex.compile(ASCII_PATTERN).findall
        newer = newer_letters() if newer is None else newer
        self.newer = regex.compile(f"[{newer}{''.join(map(chr, LATER_CAPITALS))}]").search
        # For texts that hold such code points: they are signs, neither letters nor numbers.
        signs = PATTERN.replace(r"[\p{L}]", rf"[\p{{L}}--[{newer}]]").replace(r"[\p{N}]", rf"[\p{{N}}--[{newer}]]")
        signs = signs.replace(r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]||[{newer}]]")
        self.old_words_of = regex.compile(signs, regex.V1).findall if newer else self.words_of
        self.letters = byte_letters()
        names = {i: s for s, i in [*self.vocabulary.items(), *self.special.items()]}
        self.names = [names.get(i) for i in range(max(names) + 1)]

    def pieces(self, text: str) -> Iterator[tuple[list[str], int | None]]:
        """Pre-tokens up to each special token, and the id of that token."""
        if "<|" not in text or self.split_special is None:
            yield self.words(text), None
            return
        parts = self.split_special(text)
        for i in range(0, len(parts), 2):
            yield self.words(parts[i]), self.special[parts[i + 1]] if i + 1 < len(parts) else None

    def words(self, text: str) -> list[str]:
        if text.isascii() and not _SEPARATORS.search(text):
            return self.ascii_words_of(text.lower())
        text = unicodedata.normalize("NFC", text)
        if self.newer(text):
            return self.old_words_of(lower(text.translate(LATER_CAPITALS)))
        return self.words_of(lower(text))

    def parts(self, word: str) -> list[str]:
        letters = self.letters
        parts = [letters[b] for b in word.encode()]
        parts[-1] += self.end
        return parts

    def merge(self, parts: list[str]) -> list[str]:
        return scan_ranks(parts, self.ranks) if len(parts) <= SHORT else heap_ranks(parts, self.ranks)

    def encode_word(self, word: str) -> tuple[int, ...]:
        ids = self.vocabulary
        return tuple(ids[x] for x in self.merge(self.parts(word)))

    def whole_words(self) -> list[str]:
        """Vocabulary strings proven to encode alone as one token, as they stand in texts.

        A string qualifies if its letters are the bytes of valid UTF-8, the
        pre-token pattern keeps it in one piece, and the merges lead to it.
        """
        back = {c: b for b, c in enumerate(self.letters)}
        found = []
        for name in self.vocabulary:
            if not name.endswith(self.end) or len(name) == len(self.end):
                continue
            try:
                word = bytes(back[c] for c in name[: -len(self.end)]).decode()
            except (KeyError, UnicodeDecodeError):
                continue
            if self.words(word) == [word] and self.merge(self.parts(word)) == [name]:
                found.append(word)
        return found


# Separators that the pattern's white space holds and plain ASCII classes may not.
_SEPARATORS = regex.compile("[\x1c-\x1f]")


def scan_ranks(parts: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Merges by a contiguous rank array.

    ``bounds`` holds where parts begin, ``adjacent[i]`` the rank of parts i and
    i + 1. Each round takes the minimum (the leftmost of equal ones), deletes
    the boundary between the two parts, and asks the ranks of both neighbours
    anew.
    """
    rank = ranks.get
    n = len(parts)
    if n == 1:
        return parts
    bounds = list(range(n + 1))
    spelt = list(parts)  # the part that begins at each boundary
    adjacent = [rank((parts[i], parts[i + 1]), NO_RANK) for i in range(n - 1)]
    while adjacent:
        low = min(adjacent)
        if low == NO_RANK:
            break
        i = adjacent.index(low)
        spelt[bounds[i]] += spelt[bounds[i + 1]]
        del bounds[i + 1]
        del adjacent[i]
        if i < len(adjacent):
            adjacent[i] = rank((spelt[bounds[i]], spelt[bounds[i + 1]]), NO_RANK)
        if i:
            adjacent[i - 1] = rank((spelt[bounds[i - 1]], spelt[bounds[i]]), NO_RANK)
    return [spelt[b] for b in bounds[:-1]]


def heap_ranks(parts: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """The same merges for long words, by a heap over linked parts: n log n."""
    rank = ranks.get
    n = len(parts)
    spelt: list[str | None] = list(parts)
    following = list(range(1, n + 1))
    previous = list(range(-1, n - 1))
    heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank((parts[i], parts[i + 1]))) is not None]
    heapify(heap)
    while heap:
        _, i, left, right = heappop(heap)
        j = following[i]
        if spelt[i] != left or j >= n or spelt[j] != right:
            continue
        spelt[i], spelt[j] = left + right, None
        following[i] = following[j]
        if following[i] < n:
            previous[following[i]] = i
            k = following[i]
            if (r := rank((spelt[i], spelt[k]))) is not None:
                heappush(heap, (r, i, spelt[i], spelt[k]))
        h = previous[i]
        if h >= 0 and (r := rank((spelt[h], spelt[i]))) is not None:
            heappush(heap, (r, h, spelt[h], spelt[i]))
    return [x for x in spelt if x is not None]
