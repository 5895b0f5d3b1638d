import numpy as np
import pytest

from spanveil.llm import brown


def worth(pairs, of, classes):
    member = np.eye(classes)[of]
    table = member.T @ pairs @ member
    return brown._f(table).sum() - brown._f(table.sum(axis=0)).sum() - brown._f(table.sum(axis=1)).sum()


@pytest.mark.parametrize("seed", [6, 24, 35])
def test_exchange_goes_on_until_no_move_is_better(seed):
    """sweeps ended at twelve, and by a gain that was not that of the sum."""
    rng = np.random.default_rng(seed)
    pairs = rng.poisson(rng.gamma(0.2, 2, (150, 150))).astype(float)
    of = brown.exchange(pairs, 10)
    best = worth(pairs, of, 10)
    for unit in range(150):
        for c in range(10):
            moved = of.copy()
            moved[unit] = c
            assert worth(pairs, moved, 10) <= best + 1e-6


def test_exchange_without_counts_ends():
    assert brown.exchange(np.zeros((5, 5)), 3).tolist() == [0, 1, 2, 0, 1]


def test_each_other_word_gets_the_class_that_is_best():
    """words beside the commonest stayed in a class of their shape."""
    rng = np.random.default_rng(5)
    classes, n = 6, 90
    pairs = rng.poisson(rng.gamma(0.3, 4, (n, n))).astype(float)
    np.fill_diagonal(pairs, 0)
    of = rng.integers(0, classes, n)
    member = np.eye(classes)[of]
    table = member.T @ pairs @ member
    beside = np.concatenate([pairs @ member, pairs.T @ member], axis=1)
    number, at = np.nonzero(beside)
    found = brown.best_classes(table, of, number, at, beside[number, at])
    for unit in range(n):
        worths = []
        for c in range(classes):
            moved = of.copy()
            moved[unit] = c
            worths.append(worth(pairs, moved, classes))
        assert worths[found[unit]] > max(worths) - 1e-6
    assert (found != of).mean() > 0.5


def test_words_of_one_shape_get_classes_by_their_places(spark):
    """five rarer names and five verbs of the same last bytes and length had one class in all."""
    rng, often = np.random.default_rng(2), [0.3, 0.3, *[0.08] * 5]
    names, verbs = ([f"{first}{a}xyz" for a in "abcdefg"] for first in "nv")
    texts = [" ".join(x for _ in range(12) for x in ("the", rng.choice(names, p=often), "did", rng.choice(verbs, p=often), "it")) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    real, brown.UNITS = brown.UNITS, 7
    try:
        for hot in (0, 1000):
            model = brown.train(docs, brown.F.lit(True), classes=6, hot=hot)
            words = brown._splitter().split(brown.pa.array([" ".join([*names, *verbs])])).hashes.view(np.int64)
            of = {r.word: r.of for r in model.counts.collect()}
            assert len(of) == 17 and len({of[w] for w in words[:7]}) == len({of[w] for w in words[7:]}) == 1 and of[words[0]] != of[words[7]]
            alone = brown.train(docs, brown.F.lit(True), units=7, classes=6, hot=hot)
            total, shaped = (brown.score(docs, m).agg({"score": "sum"}).first()[0] for m in (model, alone))
            assert total > shaped + 100
            got = {r.doc_id: r.score for r in brown.score(docs, model).collect()}
            if hot == 0:
                first = got
    finally:
        brown.UNITS = real
    assert all(abs(got[i] - first[i]) < 1e-6 for i in got)


def test_all_probabilities_sum_to_one(spark):
    texts = ["a b a c", "a b d e", "c a b zz", "yy a c b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    real, brown.UNITS = brown.UNITS, 2
    try:
        model = brown.train(docs, brown.F.lit(True), classes=3, hot=2)
    finally:
        brown.UNITS = real
    known = {r.word: r for r in model.counts.collect()}
    assert len(known) == 7
    before = model.of[0]
    total = sum(10 ** (model.step[before, r.of] + r.worth) for r in known.values()) + 10 ** (model.step[before, before] + model.unit[0])
    total += sum(10 ** (model.step[before, model.of[g]] + model.unit[g]) for g in range(1 + len(model.units.words), model.units.size))
    assert abs(total - 1) < 1e-9
    # Texts are worth what their words are, one after the other.
    words = brown._splitter().split(brown.pa.array(["a zz c d"])).hashes.view(np.int64)
    want, at = 0.0, before
    for r in (known[w] for w in words):
        want += model.step[at, r.of] + r.worth
        at = r.of
    want += model.step[at, before] + model.unit[0]
    probe = spark.createDataFrame([(1, "a zz c d")], "doc_id long, text string")
    assert abs(brown.score(probe, model).first().score - want) < 1e-9
