import math
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanveil.llm.negatives import Rows, encode, hard_negatives, queries, rotated

SCHEMA = "vec_id long, embedding array<float>, label int, score int, anchor string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA)


def whole(v):
    return [math.floor(256 * float(np.float32(x))) for x in v]


def mined(rows, every=50):
    """Rows of the result, by scoring every pair; missing components are zeros."""
    usable = set()
    for i, v, label in rows:
        if None not in (i, v, label) and all(x is not None and math.isfinite(x) for x in v):
            usable.add((i, tuple(whole(v)), label))
    out = []
    for i, v, label in sorted(r for r in usable if r[0] % every == 0):
        def score(other):
            return sum(a * b for a, b in zip(v, other))

        same = sorted((-score(w), j) for j, w, lab in usable if lab == label and j != i)[:5]
        rest = sorted((-score(w), j) for j, w, lab in usable if lab != label and j != i)
        for s, j in same:
            fit = [(t, k) for t, k in rest if 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(i, j, rank, k, -s, -t) for rank, (t, k) in enumerate(fit, 1)]
    return sorted(out)


def got(df, every=50):
    result = hard_negatives(df, f"vec_id % {every} = 0")
    assert result.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in result.collect())


def test_equals_all_pairs(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 0.125) for _ in range(64)], i % 4) for i in range(600)]
    assert got(table(spark, rows), 10) == mined(rows, 10)


def test_ties_repeats_nulls_and_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (50, [0.0, 1.0], 1), (50, [0.5, 0.5], 2), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1),
        (2, [1.0, 0.0], 1), (3, [0.9, 0.1], 1), (4, [0.9, 0.1], 1), (5, [0.9, 0.1], 1), (6, [0.9, 0.1], 1), (7, [0.9], 2),
        (8, [0.9, 0.0, 0.0], 2), (9, [0.9, 5.0], 3), (10, [0.9], 2), (11, [0.7, nan], 2), (12, [0.7, inf], 2), (13, [0.7, None], 2),
        (14, None, 2), (15, [0.7, 0.7], None), (None, [0.7, 0.7], 2), (16, [], 2), (17, [-1.0, -1.0], 1), (100, [], 4), (101, [], 4),
        (102, [], 5), (150, [-1.0], 6), (151, [1.0], 6), (152, [0.4], 7), (200, [0.3, 0.2], 8), (16, [], 2),
    ]
    want = mined(rows)
    assert len(want) > 10 and any(r[4] == 0 for r in want)
    assert got(table(spark, rows)) == want


def test_values_too_large_for_a_score_take_no_part(spark):
    rows = [(0, [3.0e38, 1.0], 1), (50, [0.5, 0.5], 1), (1, [0.5, 0.5], 1), (2, [0.4, 0.4], 2), (3, [1e30, 0.0], 2)]
    assert got(table(spark, rows)) == mined([r for r in rows if r[0] not in (0, 3)])
    # Large whole numbers beyond what doubles hold exactly.
    rows = [(0, [400000.5, 3.25], 1), (1, [399999.25, 7.0], 1), (2, [300000.25, 1.0], 2), (3, [300000.25, 1.25], 2)]
    assert got(table(spark, rows)) == mined(rows)


def test_empty_and_edge_tables(spark):
    assert got(table(spark, []).where("false")) == []
    assert got(table(spark, [(50, None, 1), (1, [1.0], 1)])) == []
    assert got(table(spark, [(50, [1.0], 1)])) == []


def test_hot_label_and_copies(spark):
    rng = random.Random(5)
    base = [rng.gauss(0, 0.1) for _ in range(16)]
    rows = [(i, base if i % 3 == 0 else [rng.gauss(0, 0.1) for _ in range(16)], 1 if i % 3 < 2 else i % 5) for i in range(400)]
    assert got(table(spark, rows)) == mined(rows)


def test_renamed_columns(spark):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 0.1) for _ in range(8)], i % 3) for i in range(120)]
    df = table(spark, rows).select(F.col("vec_id").alias("id"), F.col("embedding").alias("e"), F.col("label").alias("kind"))
    result = hard_negatives(df, "vec_id % 50 = 0", key="id", vector="e", label="kind")
    assert sorted(tuple(r) for r in result.collect()) == mined(rows)


def test_rotation_keeps_inner_products():
    rng = np.random.default_rng(1)
    for size in (1, 63, 64, 65, 200):
        x = rng.normal(size=(5, size))
        y = rotated(x, 64 if size <= 64 else 256)
        assert np.allclose(x @ x.T, y @ y.T)


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 130), st.integers(0, 2**32 - 1), st.sampled_from([1, 100, 100_000]))
def test_first_rows_by_intervals(size, seed, scale):
    """The first rows of any window, by codes and by scoring all; the intervals hold each true score."""
    rng = np.random.default_rng(seed)
    values = rng.integers(-scale, scale + 1, (80, size)).astype(np.int32)
    held = Rows(rng.permutation(80), rng.integers(0, 3, 80), values, *encode(values.astype(np.float64)))
    q = rng.integers(-scale, scale + 1, size).astype(np.int32)
    query, exact = queries(q[None])[0], held.values.astype(np.int64) @ q.astype(np.int64)
    estimate = np.zeros(80)
    for code, fit in zip(held.codes, held.fits):
        along = query.along(code)
        unit = np.where(np.unpackbits(np.ascontiguousarray(code.T).view(np.uint8), axis=1, bitorder="little") > 0, 1.0, -1.0) / math.sqrt(query.width)
        y = rotated(q[None].astype(np.float64), query.width)[0]
        assert (np.abs(unit @ y - along) <= query.error + 1e-6 * (1 + query.norm)).all()
        estimate += fit[0] * (unit @ y)
        assert (np.abs(exact - estimate) <= query.norm * fit[1] + 1e-6 * (1 + query.norm * held.norms)).all()
    cut = int(np.median(exact))
    windows = [(-math.inf, math.inf), (min(cut, 0) - scale, cut), (cut, cut + 5 * scale)]
    found, _ = held.best(query, np.arange(80), windows, 3)
    for (low, high), (ids, scores) in zip(windows, found):
        want = sorted((-int(s), int(i)) for s, i in zip(exact, held.ids) if low <= s <= high)[:3]
        assert [(-int(s), int(i)) for s, i in zip(scores, ids)] == want


def test_codes_spare_most_pairs():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 64))
    values = np.floor(256 * x / np.linalg.norm(x, axis=1)[:, None])
    held = Rows(np.arange(4000), np.zeros(4000, dtype=np.int64), values.astype(np.int32), *encode(values))
    scored = [held.best(q, np.arange(4000), [(-math.inf, math.inf)], 5)[1] for q in queries(values[:20].astype(np.int32))]
    assert sum(scored) < 0.1 * 20 * 4000
