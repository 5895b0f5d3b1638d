from __future__ import annotations

import random

import numpy as np
import plain
import pytest

from spanveil.llm.substrings import dedup_substrings
from spanveil.llm.words import window_minima


def result(df):
    return {r.doc_id: (r.n_words, r.kept.split()) for r in df.collect()}


def test_edges(spark, edges, nothing):
    done = dedup_substrings(edges, window=6)
    want = plain.cut_substrings([(r.doc_id, r.text) for r in edges.collect() if r.doc_id is not None], 6)
    got = result(done)
    assert got.pop(None)[0] == 12 and got == want and done.count() == edges.count()
    assert want[6][1] == [] and len(want[1][1]) == 19
    assert dedup_substrings(nothing).count() == 0
    twice = result(dedup_substrings(edges.union(edges.where("doc_id in (1, 6)")), window=6))
    twice.pop(None)
    assert twice == want


@pytest.mark.parametrize("window", [1, 2, 5, 8])
def test_random_copies(spark, window):
    rnd = random.Random(window)
    docs = [(i, " ".join(rnd.choice("abcd") for _ in range(rnd.randrange(0, 60)))) for i in range(60)]
    passages = [[f"p{j}{rnd.randrange(5)}" for _ in range(rnd.randrange(3, 20))] for j in range(6)]
    for i in range(60, 160):  # passages cut and set into other words, in any order of ids
        w = []
        for _ in range(rnd.randrange(1, 5)):
            p = rnd.choice(passages)
            a = rnd.randrange(len(p))
            w += [f"w{rnd.randrange(300)}" for _ in range(rnd.randrange(4))] + p[a : a + rnd.randrange(1, 20)]
        docs.append(((i * 37) % 1000 + 100, " ".join(w)))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    done = dedup_substrings(frame, window=window)
    assert result(done) == plain.cut_substrings(docs, window)
    for r in done.collect():
        assert sum(s.end - s.first for s in r.spans) == r.n_removed


def test_window_minima():
    rnd = np.random.default_rng(2)
    for width in (1, 2, 7):
        values = rnd.integers(0, 6, 80).astype(np.uint64)
        places = {i + max(j for j in range(width) if values[i + j] == values[i : i + width].min()) for i in range(80 - width + 1)}
        assert window_minima(values, width).tolist() == sorted(places)
