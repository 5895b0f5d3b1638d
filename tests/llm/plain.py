"""Plain Python versions of the operators, for comparison."""

from __future__ import annotations

import re

AZ = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text, lower=True):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(AZ) if lower else text or "")


def letter_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(AZ))


def leaks(docs, items, size=10):
    """id -> (n_words, n_hit, sorted item ids) of unique (id, text)."""
    windows = {}
    for item, text in items:
        w = letter_words(text)
        k = min(size, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add("" if item is None else str(item))
    sizes = {len(x) for x in windows}
    out = {}
    for doc, text in docs:
        w = letter_words(text)
        hit, found = set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in windows:
                    hit.update(range(i, i + k))
                    found |= windows[tuple(w[i : i + k])]
        out[doc] = (len(w), len(hit), sorted(found))
    return out


def shingles(text, k=4):
    w = words(text)
    k = min(k, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def near_groups(docs, least=80, k=4):
    """id -> (set size, least id reachable), for unique ids."""
    sets = {doc: shingles(text, k) for doc, text in docs}
    parent = {doc: doc for doc in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    filled = sorted(doc for doc in sets if sets[doc])
    for i, a in enumerate(filled):
        for b in filled[i + 1 :]:
            one, two = sets[a], sets[b]
            if min(len(one), len(two)) * 100 >= least * max(len(one), len(two)):
                both = len(one & two)
                if 100 * both >= least * (len(one) + len(two) - both) and root(a) != root(b):
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
    return {doc: (len(sets[doc]), root(doc)) for doc in sets}


def cut_substrings(docs, size=50):
    """id -> (words, kept words), for unique ids; removes windows that also start in a smaller id."""
    least = {}
    split = {doc: words(text, lower=False) for doc, text in docs}
    for doc in sorted(split):
        w = split[doc]
        for i in range(len(w) - size + 1):
            least.setdefault(tuple(w[i : i + size]), doc)
    out = {}
    for doc, w in split.items():
        gone = set()
        for i in range(len(w) - size + 1):
            if least[tuple(w[i : i + size])] < doc:
                gone.update(range(i, i + size))
        out[doc] = (len(w), [x for i, x in enumerate(w) if i not in gone])
    return out


def cut_lines(docs, run=3, passage=None):
    """id -> (lines, removed, text), for unique ids. ``passage``: words of a shorter run that goes as well."""
    seen, out = set(), {}
    for doc, text in sorted(docs):
        lines = [x for x in (text or "").split("\n") if x]
        gone = set()
        for k in range(1 if passage else run, run + 1):
            for i in range(len(lines) - k + 1):
                key = tuple(lines[i : i + k])
                if k < run and sum(len(words(x)) for x in key) < passage:
                    continue
                if key in seen:
                    gone.update(range(i, i + k))
                seen.add(key)
        out[doc] = (len(lines), len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text)
    return out
