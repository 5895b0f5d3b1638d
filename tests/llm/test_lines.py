from __future__ import annotations

import random

import plain
import pytest

from spanveil.llm.lines import dedup_lines


def result(df):
    return {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in df.collect()}


def test_edges(spark, edges, nothing):
    done = dedup_lines(edges, run=1)
    want = plain.cut_lines([(r.doc_id, r.text) for r in edges.collect() if r.doc_id is not None], 1)
    got = result(done)
    assert got.pop(None)[1] == 0 and got == want and want[6] == (1, 1, "")
    assert set(edges.columns) < set(done.columns) and done.count() == edges.count()
    assert dedup_lines(nothing).count() == 0


@pytest.mark.parametrize("run", [1, 2, 3])
def test_random_runs(spark, run):
    rnd = random.Random(run)
    docs = []
    for i in range(150):
        lines = [rnd.choice(["a", "b", "", "c c", " d", f"u{rnd.randrange(40)}"]) for _ in range(rnd.randrange(0, 14))]
        docs.append(((i * 53) % 400, "\n".join(lines)))
    docs.append((1000, "a\n" * 50))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert result(dedup_lines(frame, run=run)) == plain.cut_lines(docs, run)


def test_short_runs_of_many_words(spark):
    passage = " ".join(f"w{j}" for j in range(50))
    half, rest = " ".join(f"h{j}" for j in range(25)), " ".join(f"r{j}" for j in range(25))
    docs = [
        (1, passage),
        (2, passage),  # a copy of one line
        (3, f"own\n{passage}\nmore"),
        (4, f"{half}\n{rest}"),
        (5, f"{half}\n{rest}\nend"),  # two lines of 50 words together
        (6, f"{half}\nother"),  # 25 words
        (7, "a\nb\nc"),
        (8, "a\nb\nc\nd"),
    ]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {i: (gone, text) for i, (n, gone, text) in result(dedup_lines(frame, words=50)).items()}
    cut = {2: (1, ""), 3: (1, "own\nmore"), 5: (2, "end"), 8: (3, "d")}
    assert got == {i: cut.get(i, (0, text)) for i, text in docs}
    assert result(dedup_lines(frame, words=50)) == plain.cut_lines(docs, passage=50)
    assert result(dedup_lines(frame)) == plain.cut_lines(docs)


@pytest.mark.parametrize("passage", [1, 3, 6])
def test_random_passages(spark, passage):
    """Ties of hashes too: equal lines side by side, and rows of one id that occur again."""
    rnd = random.Random(passage)
    docs = []
    for i in range(120):
        lines = [rnd.choice(["a", "a", "", "c c", " d e f", f"u{rnd.randrange(9)} v w x"]) for _ in range(rnd.randrange(0, 10))]
        docs.append(((i * 53) % 400, "\n".join(lines)))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    want = plain.cut_lines(docs, passage=passage)
    assert result(dedup_lines(frame, words=passage)) == want
    twice = dedup_lines(frame.union(frame.limit(40)), words=passage)
    assert twice.count() == 160 and result(twice) == want
