from __future__ import annotations

import random

import plain
import pytest

from spanveil.llm import neardup
from spanveil.llm.components import components
from spanveil.llm.neardup import keep_one, near_duplicates
from spanveil.llm.queries import op7_minhash
from spanveil.llm.tables import documents


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_edges(spark, edges, nothing):
    rows = near_duplicates(edges, shingle=4)
    want = plain.near_groups([(r.doc_id, r.text) for r in edges.collect() if r.doc_id is not None])
    got = result(rows)
    assert got.pop(None) == (9, None) and got == want and rows.count() == edges.count()
    assert {r.doc_id for r in rows.where("NOT kept").collect()} == {6}
    assert near_duplicates(nothing).count() == 0
    kept = keep_one(edges)
    assert kept.columns == edges.columns and kept.count() == edges.count() - 1
    twice = near_duplicates(edges.union(edges.where("doc_id = 1")), shingle=4)
    assert result(twice)[1] == (16, 1) and twice.count() == edges.count() + 1


def test_chains_groups_and_short_texts(spark):
    rnd = random.Random(4)
    base = [str(rnd.randrange(10**6)) for _ in range(120)]
    docs = []
    for i in range(90):  # a chain: neighbours alike, ends not
        words = base[: i // 3] + [f"x{j}" for j in range(i // 3)] + base[i // 3 :]
        docs.append((1000 - i, " ".join(words)))
    for i in range(60):  # copies with one changed word
        words = list(reversed(base))
        words[rnd.randrange(120)] = f"y{i}"
        docs.append((2000 + i, " ".join(words)))
    docs += [(3000 + i, t) for i, t in enumerate(["a b", "A B", "a b c", "a b c d e f g h i j", "a b c d e f g h i j k", "b c d e f g h i j k"])]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for k in (4, 5):
        assert result(near_duplicates(frame, shingle=k)) == plain.near_groups(docs, k=k)


def test_components(spark):
    rnd = random.Random(9)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(500, 560)] + [(7, 7), (None, 3)]
    parent = list(range(600))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and root(a) != root(b):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    nodes = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in nodes}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query(spark, sf):
    want = plain.near_groups([(r.doc_id, r.text) for r in documents(spark, sf).collect()])
    rows = op7_minhash(spark, sf)
    assert result(rows) == want and any(x != y[1] for x, y in want.items())
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows.collect())


@pytest.mark.parametrize("paired", [2, 32])
def test_links_inside_a_template_group(spark, monkeypatch, paired):
    monkeypatch.setattr(neardup, "PAIRED", paired)
    monkeypatch.setattr(neardup, "GROUP", paired)
    rnd = random.Random(11)
    base = [f"t{j}" for j in range(200)]
    docs, fresh = [], 0
    for i in range(150):  # pairs alike at 0.80 to 0.85, in a group that is otherwise alike at 0.78
        both = [f"p{i}_{j}" for j in range(3 + i % 7)]
        for _ in range(2):
            own = [f"o{fresh}_{j}" for j in range(28 - len(both))]
            docs.append((fresh, " ".join([*base, *both, *own])))
            fresh += 1
    ids = list(range(len(docs)))
    rnd.shuffle(ids)
    docs = [(ids[i], text) for i, text in docs]
    want = plain.near_groups(docs, k=1)
    assert len({x[1] for x in want.values()}) == 150
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert result(near_duplicates(frame, shingle=1)) == want


def test_templates_within_templates(spark, monkeypatch):
    """Groups that share a bucket, a template, a part of another and many shingles of no use."""
    monkeypatch.setattr(neardup, "PAIRED", 8)
    monkeypatch.setattr(neardup, "GROUP", 16)
    rnd = random.Random(13)
    docs = []
    for i in range(240):
        first, second = [f"t{j}" for j in range(120 if i % 2 else 60)], [f"s{i % 3}_{j}" for j in range(60 if i % 2 else 110)]
        both = [f"p{i // 4}_{j}" for j in range(rnd.randrange(4, 30))]
        own = [f"o{i}_{j}" for j in range(rnd.randrange(20, 45))]
        docs.append((i, " ".join([*first, *second, *both, *own])))
    want = plain.near_groups(docs, k=1)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert result(neardup.near_duplicates(frame, shingle=1)) == want
    assert len({x[1] for x in want.values()}) > 100


def test_a_template_group_does_not_give_all_its_pairs(spark, monkeypatch):
    monkeypatch.setattr(neardup, "GROUP", 32)
    made = []
    paired = neardup._paired
    monkeypatch.setattr(neardup, "_paired", lambda *a: made.append(paired(*a)) or made[-1])
    docs = [(i, " ".join([*(f"t{j}" for j in range(200)), *(f"o{i}_{j}" for j in range(28))])) for i in range(400)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert result(neardup.near_duplicates(frame, shingle=1)) == {i: (228, i) for i, _ in docs}
    assert sum(m.count() for m in made) < 20_000  # of 79,800
