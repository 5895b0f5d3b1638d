from __future__ import annotations

import binascii

import numpy as np
import pyarrow as pa

from spanveil.llm.quality import FEATURES, Describer, Scorer, class_prior, cut_points, fit_pu, keep_good, risk_slope, score_quality, train
from spanveil.llm.queries import op2_quality
from spanveil.llm.tables import documents, labels


def test_edges(spark, edges, nothing):
    known = spark.createDataFrame([(1, 1), (1, 0), (3, None), (None, 1), (8, 0)], "doc_id long, quality int")
    scorer = train(edges, known)
    rows = score_quality(edges, scorer).collect()
    assert len(rows) == edges.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert score_quality(nothing, scorer).count() == 0
    assert keep_good(edges, scorer).columns == edges.columns
    blind = train(nothing, known.where("false"))
    assert {r.score for r in score_quality(edges, blind).collect()} == {0.5}


def test_features():
    texts = ["A b c d. A b c d. A b c d.", "ABC !! |", ""]
    rows = Describer().of(pa.array(texts))
    of = {name: rows[:, j] for j, name in enumerate(FEATURES)}
    assert of["upper"][1] == 1.0 and of["exclamations"][1] == 2 / 3 and of["bars"][1] == 1 / 3
    assert of["repeated_runs"][0] == 1 - 4 / 9 and not rows[2].any()


def test_non_negative_risk_finds_the_hidden_class():
    rnd = np.random.default_rng(5)
    width = len(FEATURES)
    good, bad = rnd.normal(0, 1, (3000, width)), rnd.normal(0, 1, (600, width))
    bad[:, 3] += 5
    scorer = fit_pu(good[:1000], np.concatenate([good[1000:], bad[:300]]), 0.87)
    assert (scorer.score(bad[300:]) < 0.5).mean() > 0.9 and (scorer.score(good) >= 0.5).mean() > 0.95


def test_slope_of_the_risk():
    """Against differences of the risk itself, written out row by row."""
    rnd = np.random.default_rng(3)
    rows = rnd.normal(0, 1, (60, 3))
    cuts = [cut_points(column) for column in rows.T]
    size = 1 + sum(len(c) + 1 for c in cuts)
    scorer = Scorer(cuts, np.zeros(size))
    in_pos, in_unl = scorer.bins(rows[:20] + 0.5), scorer.bins(rows[20:])
    loss = lambda y, g: 1 / (1 + np.exp(y * g))

    def parts(w, prior):
        margin = lambda x: np.array([w[0] + sum(w[j] for j in row) for row in x])
        pos, unl = margin(in_pos), margin(in_unl)
        on_negative = np.mean([loss(-1, g) for g in unl]) - prior * np.mean([loss(-1, g) for g in pos])
        return prior * np.mean([loss(1, g) for g in pos]), on_negative

    seen = set()
    for prior in (0.3, 0.95):
        for _ in range(6):
            w = rnd.normal(0, 1, size)
            below = parts(w, prior)[1] < 0
            seen.add(below)
            value = (lambda v: -parts(v, prior)[1]) if below else (lambda v: sum(parts(v, prior)))
            steps = np.eye(size) * 1e-5
            numeric = np.array([(value(w + s) - value(w - s)) / 2e-5 for s in steps])
            assert np.allclose(risk_slope(w, in_pos, in_unl, prior), numeric, atol=1e-6)
    assert seen == {True, False}


def test_prior_from_positives_and_unlabelled_rows():
    rnd = np.random.default_rng(8)
    width = len(FEATURES)
    for share in (0.3, 0.6, 0.9):
        good, bad = rnd.normal(0, 1, (6000, width)), rnd.normal(0, 1, (6000, width))
        bad[:, [1, 3]] += 3
        n = int(4000 * share)
        unlabelled = np.concatenate([good[2000 : 2000 + n], bad[: 4000 - n]])
        assert abs(class_prior(good[:2000], rnd.permutation(unlabelled)) - share) < 0.08
    assert class_prior(good[:0], bad) == class_prior(good, bad[:0]) == 0.5


def test_labels_of_bad_documents_are_not_used(spark, sf):
    docs, known = documents(spark, sf), labels(spark, sf)
    one, two = train(docs, known), train(docs, known.where("quality = 1"))
    assert (one.weights == two.weights).all()


def test_query(spark, sf):
    rows = op2_quality(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in documents(spark, sf).collect())
    assert all(r.held_out == (binascii.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    truth = {r.doc_id: r.quality for r in labels(spark, sf).collect()}
    held = [r.predicted == truth[r.doc_id] for r in rows if r.held_out and r.doc_id in truth]
    assert sum(held) / len(held) > 0.85
    again = op2_quality(spark, sf).collect()
    assert {r.doc_id: r.score for r in rows} == {r.doc_id: r.score for r in again}
