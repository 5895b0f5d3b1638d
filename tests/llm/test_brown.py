from __future__ import annotations

import binascii
import math
from collections import Counter

import numpy as np
import plain
from pyspark.sql import functions as F

from spanveil.llm import brown
from spanveil.llm.queries import op6_brown
from spanveil.llm.tables import documents


def base_scores(docs, trained):
    counts = Counter()
    for doc, text in docs:
        if trained(doc):
            counts.update([*plain.words(text), "\n"])
    n, v = sum(counts.values()), len(counts)
    out = {}
    for doc, text in docs:
        tokens = [*plain.words(text), "\n"]
        score = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens)
        out[doc] = (len(tokens), sum(counts[w] > 0 for w in tokens), n, round(score, 6))
    return out


def result(df):
    return {r.doc_id: (r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in df.collect()}


def test_edges_and_shuffled_counts(spark, edges, nothing):
    docs = [(r.doc_id, r.text) for r in edges.collect()]
    trained = F.col("doc_id") % 2 == 1
    want = base_scores(docs, lambda i: i is not None and i % 2 == 1)
    for hot in (200_000, 3, 0):  # all counts with the tasks, few, none
        model = brown.train(edges, trained, units=4, classes=3, hot=hot)
        done = brown.score(edges, model)
        assert result(done) == want and done.count() == edges.count()
        scores = {r.doc_id: round(r.score, 9) for r in done.collect()}
        assert all(s < 0 and math.isfinite(s) for s in scores.values()) and scores[1] > scores[6] - 1e-6
        if hot == 200_000:
            first = scores
            assert brown.score(nothing, model).count() == 0
            twice = brown.score(edges.union(edges.where("doc_id = 1")), model)
            assert twice.count() == edges.count() + 1 and result(twice) == want
    assert len(first) == len(docs)
    blind = brown.score(edges, brown.train(nothing, trained))
    assert {(r.n_known, r.train_tokens, r.base_score) for r in blind.collect()} == {(0, 0, 0.0)}


def test_probabilities_sum_to_one(spark):
    texts = ["a b a c", "a b d e", "c a b zz", "yy a c b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = brown.train(docs, F.lit(True), units=3, classes=2)
    words = sorted({w for t in texts for w in t.split()})
    # Texts of one word: P(word | end) * P(end | class of word).
    probe = spark.createDataFrame([(i, w) for i, w in enumerate([*words, "unseen", ""])], "doc_id long, text string")
    scores = {r.doc_id: r.score for r in brown.score(probe, model).collect()}
    split = brown._splitter()
    import pyarrow as pa

    units = model.units.of(split.split(pa.array([*words, "unseen"])))
    end = lambda u: model.step[model.of[u], model.of[0]] + model.unit[0]
    total = sum(10 ** (scores[i] - end(units[i])) for i in range(len(words))) + 10 ** scores[len(words) + 1]
    groups = range(1 + len(model.units.words), model.units.size)
    seen_groups = {int(u) for u in units[: len(words)] if u in groups}
    # What is left: one unknown word in each group.
    rest = 0.0
    for g in groups:
        own = 10 ** (model.step[model.of[0], model.of[g]] + model.unit[g])
        rest += own
    assert seen_groups and abs(total + rest - 1) < 1e-9


def test_exchange_finds_the_classes():
    rnd = np.random.default_rng(3)
    of = rnd.integers(0, 3, 30)
    rates = np.array([[1, 20, 1], [1, 1, 20], [20, 1, 1]])
    pairs = rnd.poisson(rates[of][:, of] * 3).astype(float)
    found = brown.exchange(pairs, 3, 30)
    assert all(len(set(found[of == c])) == 1 for c in range(3)) and len(set(found)) == 3


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in documents(spark, sf).collect()]
    held = lambda i: binascii.crc32(str(i).encode()) % 7 == 2
    rows = op6_brown(spark, sf)
    got = rows.collect()
    want = base_scores(docs, lambda i: not held(i))
    assert result(rows) == want and all(r.held_out == held(r.doc_id) for r in got)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
