from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from spanveil.llm.fingerprints import ANCHORS, CHAIN, Signatures, fingerprints, likeness, neighbours, pruned_jaccard
from spanveil.llm.queries import op4_spotsigs
from spanveil.llm.tables import documents


def edited(text, after):
    third = len(text) // 3
    return text[: len(text) - third] + after[:third]


def plain(rows):
    """What `neighbours` returns of (id, text), except for the fingerprints."""
    rows = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(10**18)), r[1]))
    out = {}
    for i, (doc, text) in enumerate(rows):
        new = edited(text, rows[(i + 1) % len(rows)][1])
        out[doc] = (len(text), hashlib.sha256(new.encode()).hexdigest())
    return out


def test_edges(spark, edges, nothing):
    want = plain([(r.doc_id, r.text or "") for r in edges.collect()])
    got = neighbours(edges).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in got} == want and len(got) == edges.count()
    prints = {r.doc_id: r.fingerprint for r in got}
    assert prints[1] == prints[6] and prints[2] == prints[3] == prints[4] == ""
    assert prints == {r.doc_id: r.fingerprint for r in fingerprints(edges).collect()}
    assert neighbours(nothing).count() == 0
    one = neighbours(edges.where("doc_id = 1")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    wide = spark.createDataFrame([(-(2**62), "the red house"), (2**62, "the blue tree"), (0, "the old dog")], "doc_id long, text string")
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in neighbours(wide).collect()} == plain([(r.doc_id, r.text) for r in wide.collect()])


def test_pruned_jaccard_equals_sets():
    rnd = random.Random(3)
    for _ in range(300):
        a = np.array(sorted(rnd.sample(range(60), rnd.randrange(0, 40))), dtype=np.uint32)
        b = np.array(sorted(rnd.sample(range(60), rnd.randrange(0, 40))), dtype=np.uint32)
        union = set(a.tolist()) | set(b.tolist())
        exact = len(set(a.tolist()) & set(b.tolist())) / len(union) if union else 1.0
        assert pruned_jaccard(a, b) == exact
        assert pruned_jaccard(a, b, 0.6) == (exact if exact >= 0.6 else 0.0)


def chains(text):
    """Signatures of a text in which no stretch without common words is long: anchors with the words behind them, numbered."""
    words = re.findall(r"[a-z0-9\x80-\U0010ffff]+", text.lower())
    common = [w in ANCHORS for w in words]
    found = [("", 0)] if words else []
    found += [(w, i + 1) for i, w in enumerate(words) if common[i]]
    found = [(a, tuple(w for w, c in zip(words[k:], common[k:]) if not c)[:CHAIN]) for a, k in found]
    if not all(common):
        found = [f for f in found if f[1]]
    seen = Counter()
    out = set()
    for f in found:
        out.add((f, seen[f]))
        seen[f] += 1
    return out


def test_signatures_word_by_word():
    rnd = random.Random(6)
    some = ["the", "of", "der", "und", "house", "dog", "river", "blue", "x1", "é", "and"]
    texts = [" ".join(rnd.choice(some) for _ in range(rnd.randrange(20))) for _ in range(120)]
    texts += ["the of and a", "der die das", "the of and a", "the the", "the", "", "...", "dog", "House DOG"]
    sets, plainly = Signatures().of(texts), [chains(t) for t in texts]
    assert [len(s) for s in sets] == [len(c) for c in plainly]
    for i, (a, x) in enumerate(zip(sets, plainly)):
        for b, y in zip(sets[i:], plainly[i:]):
            assert pruned_jaccard(a, b) == (len(x & y) / len(x | y) if x | y else 1.0)


def test_rows_that_occur_again(spark, edges):
    twice = edges.where("doc_id IS NOT NULL").union(edges.where("doc_id = 1"))
    got = neighbours(twice).collect()
    assert len(got) == twice.count()
    assert len({(r.n_chars, r.fingerprint) for r in got if r.doc_id == 1}) == 1


def test_query(spark, sf):
    want = plain([(r.doc_id, r.text) for r in documents(spark, sf).collect()])
    got = op4_spotsigs(spark, sf)
    rows = got.collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in rows} == want
    again = got.select("near_edited", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("x")).collect()
    assert all(r.x == r.near_edited for r in again)
    texts = {r.doc_id: r.fingerprint for r in rows}
    by_text = {}
    for r in documents(spark, sf).collect():
        assert by_text.setdefault(r.text, texts[r.doc_id]) == texts[r.doc_id]
    assert sum(r.near_edited for r in rows) / len(rows) > 0.4 > 0.05 > sum(r.near_next for r in rows) / len(rows)
