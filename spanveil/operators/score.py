"""Predicted against gold spans: counts, precision, recall and F1.

Spans match inside one row on ``(start, end, label)``, or on ``(start, end)``
when labels are ignored. Row and corpus totals compare the two span sets;
totals per label count the lists, where a repeated span counts each time, so
the two need not add up to each other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanveil.functions.arrays import bind, running
from spanveil.functions.text import name
from spanveil.sources.shared import written

# Fixed value: keeps the ratios defined when there is nothing to count.
EPSILON = 1e-9


def _keys(spans_col: str, ignore_labels: bool, output: str) -> Column:
    """Spans as strings; on strings Spark's array set functions use hash sets."""
    # A null has a mark of its own, and the label comes last: no two spans share a key.
    place = "coalesce(CAST(s.start AS STRING), 'n'), ':', coalesce(CAST(s.end AS STRING), 'n')"
    label = "" if ignore_labels else ", if(s.label IS NULL, '', concat(':', s.label))"
    return F.expr(f"transform({name(spans_col)}, s -> concat({place}{label}))").alias(output)


def score_rows(
    df: DataFrame, pred_col: str, gold_col: str, ignore_labels: bool = False
) -> DataFrame:
    """Append ``tp``, ``fp`` and ``fn`` of each row. No exchange."""
    keyed = df.drop("tp", "fp", "fn").select(
        "*", _keys(pred_col, ignore_labels, "_pred_keys"), _keys(gold_col, ignore_labels, "_gold_keys")
    )
    return keyed.selectExpr(
        "*",
        "CAST(size(array_intersect(_pred_keys, _gold_keys)) AS BIGINT) AS tp",
        "CAST(size(array_except(_pred_keys, _gold_keys)) AS BIGINT) AS fp",
        "CAST(size(array_except(_gold_keys, _pred_keys)) AS BIGINT) AS fn",
    ).drop("_pred_keys", "_gold_keys")


def with_ratios(counts: DataFrame) -> DataFrame:
    """Append ``precision``, ``recall`` and ``f1`` to a table with tp, fp and fn."""
    return counts.selectExpr(
        "*", f"tp / (tp + fp + {EPSILON}D) AS precision", f"tp / (tp + fn + {EPSILON}D) AS recall"
    ).selectExpr("*", f"2 * precision * recall / (precision + recall + {EPSILON}D) AS f1")


def score(df: DataFrame, pred_col: str, gold_col: str, ignore_labels: bool = False) -> DataFrame:
    """One row: corpus totals of tp, fp and fn with the ratios over them."""
    rows = score_rows(df.select(pred_col, gold_col), pred_col, gold_col, ignore_labels)
    return with_ratios(rows.agg(*[F.expr(f"coalesce(sum({c}), 0)").alias(c) for c in ("tp", "fp", "fn")]))


def score_by_label(
    df: DataFrame, pred_col: str, gold_col: str, ignore_labels: bool = False
) -> DataFrame:
    """One row per label: counts over span lists and the ratios over them.

    A hit counts for the label of the predicted span, a miss for the label of
    the gold span. The counts are summed per label before the exchange.
    """
    keyed = _keyed(df, pred_col, gold_col, ignore_labels)
    rows = keyed.select(F.expr(_tagged()).alias("tagged")).select(F.expr(f"explode({_hits('tagged')})").alias("m"))
    marks = rows.select("m.label", (F.col("m.side") == 2).alias("gold"), "m.hit").where(F.col("m.side") > 0)
    counts = marks.groupBy("label").agg(
        F.expr("count_if(NOT gold AND hit)").alias("tp"),
        F.expr("count_if(NOT gold AND NOT hit)").alias("fp"),
        F.expr("count_if(gold AND NOT hit)").alias("fn"),
    )
    # A label whose gold spans were all found and that was never predicted
    # (possible when labels are ignored) has no counts and no row.
    return with_ratios(counts.filter("tp + fp + fn > 0"))


def _keyed(df: DataFrame, pred_col: str, gold_col: str, ignore_labels: bool) -> DataFrame:
    return df.select(
        F.col(pred_col).alias("_pred"),
        F.col(gold_col).alias("_gold"),
        _keys(pred_col, ignore_labels, "_pred_keys"),
        _keys(gold_col, ignore_labels, "_gold_keys"),
    )


def _tagged() -> str:
    """Spans of both lists in order of key, each key that both hold led by a mark of side 0."""
    both = "transform(array_intersect(_pred_keys, _gold_keys), k -> named_struct('key', k, 'side', 0, 'label', CAST(NULL AS STRING)))"
    side = lambda spans, keys, n: (
        f"transform({spans}, (s, i) -> named_struct('key', get({keys}, i), 'side', {n}, 'label', s.label))"
    )
    return f"array_sort(concat({both}, {side('_pred', '_pred_keys', 1)}, {side('_gold', '_gold_keys', 2)}))"


def _hits(tagged: str) -> str:
    """``label, side, hit``: a span is a hit if the last mark before it has its key. n log n for n spans of a row."""
    last = running(f"transform({tagged}, (t, i) -> if(t.side = 0, i, -1))", "greatest(x, y)")
    return bind(
        last,
        "last",
        f"transform({tagged}, (t, i) -> named_struct('label', t.label, 'side', t.side, "
        f"'hit', coalesce(get({tagged}, if(get(last, i) < 0, NULL, get(last, i))).key = t.key, false)))",
    )


def score_with_labels(
    df: DataFrame, pred_col: str, gold_col: str, ignore_labels: bool = False
) -> tuple[DataFrame, DataFrame]:
    """What `score` and `score_by_label` give, from one read of ``df``.

    Each row sends its own counts along with those of its spans into the same
    partial sums; what is written, and read for both tables, is a row per label.
    """
    count = lambda c: f"CAST(size({c}) AS BIGINT)"
    row = (
        "named_struct('total', true, 'label', CAST(NULL AS STRING), "
        f"'tp', {count('array_intersect(_pred_keys, _gold_keys)')}, 'fp', {count('array_except(_pred_keys, _gold_keys)')}, "
        f"'fn', {count('array_except(_gold_keys, _pred_keys)')})"
    )
    flag = lambda condition: f"if({condition}, 1L, 0L)"
    span = (
        f"named_struct('total', false, 'label', m.label, 'tp', {flag('m.side = 1 AND m.hit')}, "
        f"'fp', {flag('m.side = 1 AND NOT m.hit')}, 'fn', {flag('m.side = 2 AND NOT m.hit')})"
    )
    marks = f"transform(filter({_hits('tagged')}, m -> m.side > 0), m -> {span})"
    tagged = _keyed(df, pred_col, gold_col, ignore_labels).selectExpr("_pred_keys", "_gold_keys", f"{_tagged()} AS tagged")
    # A row without one of its lists has no counts, as in the two tables by themselves.
    rows = tagged.selectExpr(f"explode(concat(array({row}), coalesce({marks}, array()))) AS m").select("m.*")
    names = ("tp", "fp", "fn")
    sums = written(rows.groupBy("total", "label").agg(*[F.sum(c).alias(c) for c in names]), "scores")
    totals = sums.where("total").agg(*[F.expr(f"coalesce(sum({c}), 0)").alias(c) for c in names])
    return with_ratios(totals), with_ratios(sums.where("NOT total AND tp + fp + fn > 0").drop("total"))


def rounded(scores: DataFrame, digits: int = 4) -> DataFrame:
    """The ratios at ``digits`` decimals, for a report."""
    return scores.withColumns({c: F.round(c, digits) for c in ("precision", "recall", "f1")})


def stacked(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """Both span tables as one, ``p`` 1 for a predicted span and ``g`` 1 for a gold one."""
    return pred.selectExpr("*", "1 AS p", "0 AS g").unionByName(gold.selectExpr("*", "0 AS p", "1 AS g"))


def stacked_rows(df: DataFrame, pred_col: str, gold_col: str, *keep: str) -> DataFrame:
    """The spans of two array columns as `stacked` gives them, in one pass over ``df``."""
    side = lambda c, p: f"transform({name(c)}, s -> named_struct('s', s, 'p', {p}, 'g', {1 - p}))"
    # filter() keeps Spark from pushing a size test below the projection that computes the spans.
    spans = f"filter(concat({side(pred_col, 1)}, {side(gold_col, 0)}), t -> t.s IS NOT NULL)"
    rows = df.select(*keep, F.expr(f"explode({spans})").alias("_t"))
    return rows.select(*keep, "_t.s.*", "_t.p", "_t.g")


def _counted(spans: DataFrame, key: Sequence[str]) -> DataFrame:
    """Repeats of each key counted in ``p`` and ``g``.

    Repeats go on the map side and one exchange is enough; joining the tables
    would take three. The key holds the span, so a text with very many spans
    is spread over the tasks.
    """
    return spans.groupBy(*key).agg(F.sum("p").alias("p"), F.sum("g").alias("g"))


def score_long_form(spans: DataFrame, id_cols: Sequence[str], ignore_labels: bool = False) -> DataFrame:
    """Corpus totals for spans one per row, as `stacked` or `stacked_rows` give them; same counts as ``score``."""
    key = [*id_cols, "start", "end", *([] if ignore_labels else ["label"])]
    return with_ratios(
        _counted(spans, key).agg(
            F.expr("count_if(p > 0 AND g > 0)").alias("tp"),
            F.expr("count_if(p > 0 AND g = 0)").alias("fp"),
            F.expr("count_if(p = 0 AND g > 0)").alias("fn"),
        )
    )


def score_long_form_by_label(spans: DataFrame, id_cols: Sequence[str], ignore_labels: bool = False) -> DataFrame:
    """Scores per label for spans one per row, as `stacked` gives them; same counts as ``score_by_label``.

    With labels ignored, the labels found at one place have to see each other:
    a window over the place, which holds at most one row per label.
    """
    spans = _counted(spans, [*id_cols, "start", "end", "label"])
    p_here, g_here = F.col("p"), F.col("g")
    if ignore_labels:
        place = Window.partitionBy(*id_cols, "start", "end")
        p_here, g_here = F.sum("p").over(place), F.sum("g").over(place)
    counts = (
        spans.select("label", "p", "g", p_here.alias("p_here"), g_here.alias("g_here"))
        .groupBy("label")
        .agg(
            F.expr("sum(if(g_here > 0, p, 0))").alias("tp"),
            F.expr("sum(if(g_here = 0, p, 0))").alias("fp"),
            F.expr("sum(if(p_here = 0, g, 0))").alias("fn"),
        )
    )
    return with_ratios(counts.filter("tp + fp + fn > 0"))
