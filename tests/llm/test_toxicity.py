from __future__ import annotations

import binascii
import math
import random
import re

import numpy as np

from spanveil.llm.queries import op3_toxicity
from spanveil.llm.tables import documents, labels
from spanveil.llm.toxicity import MARKS, QUOTED, SAYING, WINDOW, Automaton, Judge, Lexicon, allowed, score_toxicity, train


def distance(a, b):
    """Edits, a swap of neighbours counting one (no letter edited twice)."""
    rows = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            rows[i][j] = min(rows[i - 1][j] + 1, rows[i][j - 1] + 1, rows[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                rows[i][j] = min(rows[i][j], rows[i - 2][j - 2] + 1)
    return rows[-1][-1]


def test_automaton_equals_edit_distance():
    rnd = random.Random(7)
    terms = ["abc", "abcab", "bcabcc", "aabbccaa", "cabcabcab"]
    automaton = Automaton(terms)
    for _ in range(4000):
        word = "".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 11)))
        near = [t for t in terms if distance(word, t) <= allowed(t)]
        found = automaton.find(word)
        assert (found is not None) == bool(near), word
        if found:
            assert found[0] in near and found[1] == min(distance(word, t) for t in near)


def test_misspelling_stem_and_quotation():
    judge = Judge(Lexicon({"idiot": 1.0}, {"vequ": 0.8}, {"idiom"}))
    plain, quoted = judge.of("you are an idiot today"), judge.of('he used "idiot" in a talk')
    assert judge.of("you are an idiott today")[1] == judge.of("such an iidot")[1] == 0.5
    assert judge.of("an idiom")[1] == 0.0 and judge.of("le vequment")[1] == 0.8
    assert quoted[1] == QUOTED * plain[1] > 0


def judged(text, lexicon):
    """Score of a text, word by word: nearest term by distance, quotation by looking at the words around."""
    text = text.lower()
    words = [(m.group(), *m.span()) for m in re.finditer(r"[^\W\d_]+", text)]
    weights = []
    for i, (word, start, end) in enumerate(words):
        stem = [w for s, w in lexicon.stems.items() if word.startswith(s)]
        near = sorted((distance(word, t), t) for t in lexicon.terms if distance(word, t) <= allowed(t))
        if word in lexicon.terms:
            weight = lexicon.terms[word]
        elif stem:
            weight = stem[0]
        elif near and word not in lexicon.innocent:
            weight = lexicon.terms[near[0][1]] / (1 + near[0][0])
        else:
            continue
        before = text[words[max(0, i - WINDOW)][1] : start]
        after = text[end : words[min(len(words) - 1, i + WINDOW)][2] + 1]
        quoted = any(m in before for m in MARKS) and any(m in after for m in MARKS)
        said = any(w in SAYING for w, _, _ in words[max(0, i - WINDOW) : i])
        weights.append(weight * (QUOTED if quoted or said else 1))
    total = sum(weights)
    features = [math.log1p(total), max(weights, default=0), math.log1p(100 * total / max(len(words), 1)), 1.0]
    return 1 / (1 + math.exp(-sum(f * w for f, w in zip(features, lexicon.weights))))


def test_scores_word_by_word(spark):
    rnd = random.Random(12)
    lexicon = Lexicon({"scum": 0.9, "idiot": 1.0, "vermin": 0.6, "blockhead": 0.7}, {"vequ": 0.8}, {"idiom", "scam"})
    lexicon.weights = np.array([1.5, 2.0, 0.4, -3.0])
    parts = ["scum", "scvm", "scumm", "scam", "idiot", "idiom", "iidot", "vermin", "vermn", "blockhead", "blokchaed", "vequment", "the", "said",
             "quote", "a", "green", "\"", "“", "”", ",", "3", "Wort", "SCUM", "é"]
    texts = [" ".join(rnd.choice(parts) for _ in range(rnd.randrange(30))) for _ in range(300)]
    texts += texts[:20] + ["", "scum"]  # rows that occur again
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in score_toxicity(docs, lexicon).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        assert math.isclose(got[i], judged(text, lexicon), abs_tol=1e-9), text


def test_short_terms_misspelt():
    judge = Judge(Lexicon({"scum": 1.0, "pig": 1.0}, {}, {"scam"}))
    assert judge.of("you scvm")[1] == judge.of("you scumm")[1] == judge.of("you scmu")[1] == 0.5
    assert judge.of("a scam")[1] == judge.of("a pin")[1] == 0 and judge.of("a pig")[1] == 1.0


def texts_and_labels(spark):
    rnd = random.Random(1)
    rows, known = [], []
    for i in range(300):
        words = [rnd.choice("abcdefgh") * rnd.randrange(3, 7) for _ in range(30)]
        toxic = i % 3 == 0
        if toxic:
            for _ in range(3):
                words.insert(rnd.randrange(len(words)), "rotten")
        rows.append((i, " ".join(words)))
        known.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs, spark.createDataFrame(known, "doc_id long, toxic int")


def test_learns_and_edges(spark, edges, nothing):
    docs, known = texts_and_labels(spark)
    lexicon = train(docs, known)
    assert set(lexicon.terms) == {"rotten"}
    truth = {r.doc_id: r.toxic for r in known.collect()}
    assert all(r.predicted == truth[r.doc_id] for r in score_toxicity(docs, lexicon).collect())
    rows = score_toxicity(edges, lexicon).collect()
    assert len(rows) == edges.count() and not any(r.predicted for r in rows)
    assert score_toxicity(nothing, lexicon).count() == 0
    blind = train(nothing, known.where("false"))
    assert not blind.terms and not any(r.predicted for r in score_toxicity(docs, blind).collect())


def test_query(spark, sf):
    rows = op3_toxicity(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in documents(spark, sf).collect())
    assert all(r.held_out == (binascii.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    truth = {r.doc_id: r.toxic for r in labels(spark, sf).collect()}
    known = [r for r in rows if r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in known) / len(known) > 0.85
