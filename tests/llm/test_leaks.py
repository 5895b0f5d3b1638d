from __future__ import annotations

import random

import plain
import pytest

from spanveil.llm import leaks
from spanveil.llm.leaks import contamination, keep_clean

ITEMS = [
    (1, "the small DOG stood in a wide green field near the old river"),
    (2, "one"),
    (3, "Small dog"),
    (4, None),
    (5, " ... "),
    (None, "word word word"),
    (1, "the small dog stood in a wide green field near the old river"),
    (10, "stood in a wide green field near the old river of the town"),
]


def result(df):
    return {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in df.collect()}


@pytest.mark.parametrize("room", [8 << 20, 20])
def test_edges_of_few_and_of_many_items(spark, edges, nothing, monkeypatch, room):
    monkeypatch.setattr(leaks, "ITEM_BYTES", room)
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, hits string")
    want = plain.leaks([(r.doc_id, r.text) for r in edges.collect()], ITEMS)
    found = contamination(edges, items)
    assert result(found) == want and found.count() == edges.count()
    assert want[1][1] > 10 and want[5][1] == 1 and want[8][1] == 3000
    assert all(r.contaminated == (r.n_hit > 0) and r.n_items == len(r["items"]) for r in found.collect())
    kept = keep_clean(edges, items)
    assert kept.columns == edges.columns and {r.doc_id for r in kept.collect()} == {i for i, x in want.items() if not x[1]}
    assert contamination(nothing, items).count() == 0
    assert not any(r.contaminated for r in contamination(edges, items.where("false")).collect())


def random_tables(spark, seed):
    rnd = random.Random(seed)
    common, rare = list("abcdefgh"), [f"w{i}" for i in range(300)]
    word = lambda: rnd.choice(common) if rnd.random() < 0.6 else rnd.choice(rare)
    items = [(i // 2, " ".join(word() for _ in range(rnd.randrange(0, 16)))) for i in range(40)]
    items += [(90, "a a a a a a a a a a a a"), (91, items[5][1]), (None, items[6][1])]
    docs = []
    for i in range(120):
        words = [word() for _ in range(rnd.randrange(0, 40))]
        if i % 3 == 0:
            words[rnd.randrange(len(words) + 1) :] = items[rnd.randrange(40)][1].split() + [word()] * (i % 2)
        docs.append((i, " ".join(words)))
    docs += [(500, "a " * 400), (501, items[3][1]), (502, None)] + [(600 + i, docs[3][1]) for i in range(60)]
    return docs, items


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("room", [8 << 20, 0])
def test_random_items_in_memory_and_joined(spark, monkeypatch, seed, room):
    """Windows of hot words, items and rows that occur again, a third of the documents one text."""
    monkeypatch.setattr(leaks, "ITEM_BYTES", room)
    docs, items = random_tables(spark, seed)
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, row long, window string").repartition(5)
    item_frame = spark.createDataFrame(items, "item_id long, text string")
    want = plain.leaks(docs, items)
    assert result(contamination(frame, item_frame)) == want and sum(bool(x[1]) for x in want.values()) > 30
    kept = keep_clean(frame, item_frame)
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, x in want.items() if not x[1])
    twice = contamination(frame.union(frame), item_frame)
    assert twice.count() == 2 * len(docs) and result(twice) == want


def test_joined_items_stay_off_the_driver(spark, monkeypatch):
    """However many items, the driver gets maps and sketches alone."""
    monkeypatch.setattr(leaks, "ITEM_BYTES", 0)
    docs, items = random_tables(spark, 5)
    collected = []
    frame = type(spark.range(1))
    whole = frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: collected.append(whole(self)) or collected[-1])
    found = contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    # One sum of bytes.
    assert [len(rows) for rows in collected] == [1] and [len(r) for r in collected[0]] == [1]
    assert found.count() == len(docs)
