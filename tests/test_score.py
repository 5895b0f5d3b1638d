import random
import time

import pytest
from pyspark.sql import functions as F

from brute import score as brute_score
from spanveil.functions.spans import SPANS_DDL, span_rows
from spanveil.operators import score as score_module
from spanveil.operators.score import (
    rounded,
    score,
    score_by_label,
    score_long_form,
    score_long_form_by_label,
    score_rows,
    score_with_labels,
    stacked,
    stacked_rows,
)

S = lambda label, start, end: (label, "v", start, end)
EXAMPLE = ([S("A", 0, 5), S("A", 0, 5), S("B", 6, 9)], [S("A", 0, 5), S("C", 10, 12)])


def frame(spark, rows):
    return spark.createDataFrame(
        [(i, p, g) for i, (p, g) in enumerate(rows)], f"id INT, pred {SPANS_DDL}, gold {SPANS_DDL}"
    )


def by_label(df):
    return {r["label"]: (r["tp"], r["fp"], r["fn"]) for r in df.collect()}


def test_example_counts_sets_and_lists(spark):
    df = frame(spark, [EXAMPLE])
    row = score(df, "pred", "gold").first()
    assert (row["tp"], row["fp"], row["fn"]) == (1, 1, 1)
    assert row["precision"] == pytest.approx(1 / (2 + 1e-9), abs=1e-15)
    assert by_label(score_by_label(df, "pred", "gold")) == {"A": (2, 0, 0), "B": (0, 1, 0), "C": (0, 0, 1)}


def test_no_spans_and_no_rows(spark):
    for df in (frame(spark, [([], [])]), frame(spark, [([], [])]).limit(0)):
        row = score(df, "pred", "gold").first()
        assert [row[c] for c in ("tp", "fp", "fn", "precision", "recall", "f1")] == [0, 0, 0, 0.0, 0.0, 0.0]
        assert score_by_label(df, "pred", "gold").count() == 0


@pytest.mark.parametrize("ignore", [False, True])
def test_random_spans_all_forms(spark, ignore):
    rng = random.Random(13)
    spans = lambda: [S(rng.choice("ABC"), s := rng.randrange(4), s + rng.randrange(3)) for _ in range(rng.randrange(6))]
    rows = [(spans(), spans()) for _ in range(300)]
    df = frame(spark, rows)
    want = [brute_score(p, g, ignore) for p, g in rows]
    got = score_rows(df, "pred", "gold", ignore).orderBy("id").collect()
    assert [(r["tp"], r["fp"], r["fn"]) for r in got] == [w[0] for w in want]

    totals = tuple(sum(w[0][i] for w in want) for i in range(3))
    labels = {}
    for _, per_label in want:
        for label, counts in per_label.items():
            labels[label] = tuple(a + b for a, b in zip(labels.get(label, (0, 0, 0)), counts))
    pred, gold = span_rows(df, "pred", "id"), span_rows(df, "gold", "id")
    for table in (score(df, "pred", "gold", ignore), score_long_form(stacked(pred, gold).drop("pos"), ["id"], ignore)):
        row = table.first()
        assert (row["tp"], row["fp"], row["fn"]) == totals
        p, r = totals[0] / (totals[0] + totals[1] + 1e-9), totals[0] / (totals[0] + totals[2] + 1e-9)
        assert (row["precision"], row["recall"]) == (p, r)
        assert row["f1"] == 2 * p * r / (p + r + 1e-9)
    assert by_label(score_by_label(df, "pred", "gold", ignore)) == labels
    assert by_label(score_long_form_by_label(stacked(pred, gold), ["id"], ignore)) == labels
    assert by_label(score_long_form_by_label(stacked_rows(df, "pred", "gold", "id"), ["id"], ignore)) == labels


def test_keys_of_null_offsets_do_not_collide(spark):
    df = frame(spark, [([("A", "v", None, 5), (None, "v", 1, 2)], [("A", "v", 5, None), (None, "v", 1, 2), ("", "v", 1, 2)])])
    row = score(df, "pred", "gold").first()
    assert (row["tp"], row["fp"], row["fn"]) == (1, 1, 2)


def test_many_spans_in_one_row(spark):
    spans = [S("A", i, i + 1) for i in range(32_000)]
    df = frame(spark, [(spans, spans[::2] + [S("B", i, i) for i in range(16_000)])])
    by_label(score_by_label(df.limit(0), "pred", "gold"))
    started = time.monotonic()
    assert by_label(score_by_label(df, "pred", "gold")) == {"A": (16_000, 16_000, 0), "B": (0, 0, 16_000)}
    assert time.monotonic() - started < 8


def test_label_whose_gold_was_found_under_another_label_has_no_row(spark):
    df = frame(spark, [([S("A", 0, 1)], [S("B", 0, 1)])])
    assert by_label(score_by_label(df, "pred", "gold", True)) == {"A": (1, 0, 0)}


def test_report_digits(spark):
    row = rounded(score(frame(spark, [EXAMPLE]), "pred", "gold")).first()
    assert (row["precision"], row["recall"], row["f1"]) == (0.5, 0.5, 0.5)


@pytest.mark.parametrize("ignore", [False, True])
def test_both_tables_at_once(spark, ignore):
    rng = random.Random(21)
    spans = lambda: [S(rng.choice(["A", "B", "C", None]), s := rng.randrange(4), s + rng.randrange(3)) for _ in range(rng.randrange(6))]
    rows = [(spans(), spans()) for _ in range(200)] + [(None, spans()), (spans(), None), (None, None), EXAMPLE]
    for df in (frame(spark, rows), frame(spark, rows).limit(0)):
        totals, labels = score_with_labels(df, "pred", "gold", ignore)
        assert totals.collect() == score(df, "pred", "gold", ignore).collect()
        key = lambda r: str(r["label"])
        assert sorted(labels.collect(), key=key) == sorted(score_by_label(df, "pred", "gold", ignore).collect(), key=key)


def test_both_tables_read_once(spark, tmp_path, monkeypatch):
    frame(spark, [EXAMPLE]).write.parquet(str(tmp_path / "spans"))
    plans = []
    whole = score_module.written
    monkeypatch.setattr(
        score_module, "written",
        lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or whole(df, name),
    )
    totals, labels = score_with_labels(spark.read.parquet(str(tmp_path / "spans")), "pred", "gold")
    assert totals.count() == 1 and labels.agg(F.sum("tp")).first()[0] == 2
    assert len(plans) == 1 and plans[0].count("FileScan") == 1 and plans[0].count("Exchange") == 1
